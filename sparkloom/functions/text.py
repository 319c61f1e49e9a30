"""Text columns: cleaning, metadata, prompts, chat rendering. All row-local expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, functions as F, types as T

# The characters a Unicode-aware strip removes, as a pattern class and as text.
WHITESPACE = (
    r"\t-\r\x1c-\x20\x85\xa0\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
)
STRIP_CHARACTERS = (
    "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007"
    "\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"
)
# Fixed value: byte order mark.
BOM = "\ufeff"

# Task names and their class ids; anything else is OTHER_CLASS.
TASK_CLASSES = {
    "Single QA": 0,
    "MultiHop QA": 1,
    "Summarization": 2,
    "Code": 3,
    "In-Context Learning": 4,
}
OTHER_CLASS = 5
UNKNOWN_TASK = "Unknown"

# Lead-ins and ending of two tasks.
SUMMARY_LEAD = "You are given several news passages. Write a one-page summary of all news."
SUMMARY_END = "\n\nSummary:"
CODE_LEAD = "Please complete the code given below."

METADATA_TYPE = T.StructType(
    [
        T.StructField("task", T.StringType()),
        T.StructField("is_prefix", T.BooleanType()),
        T.StructField("length", T.StringType()),
    ]
)


# a quoted string with escapes, or what stands between such strings
QUOTED_OR_NOT = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[^'"]+|['"]"""


def clean_text(text: Column) -> Column:
    """Null becomes empty; byte order marks are removed anywhere."""
    return F.replace(F.coalesce(text, F.lit("")), F.lit(BOM), F.lit(""))


def rstrip(text: Column) -> Column:
    return F.rtrim(text, F.lit(STRIP_CHARACTERS))


def lstrip(text: Column) -> Column:
    return F.ltrim(text, F.lit(STRIP_CHARACTERS))


def parse_metadata(metadata: Column, data_type: T.DataType) -> Column:
    """Struct ``(task, is_prefix, length)`` from a struct or a Python-literal string.

    Null, empty and unreadable metadata give the defaults ``Other`` and true. A
    field that is present with a null value stays as read: no task, not a prefix.
    """
    if isinstance(data_type, T.StructType):
        names = data_type.fieldNames()

        def field(name: str, default: Column) -> Column:
            return metadata[name] if name in names else default

        return F.when(
            metadata.isNotNull(),
            F.struct(
                field("task", F.lit("Other")).alias("task"),
                F.coalesce(field("is_prefix", F.lit(True)).cast("boolean"), F.lit(False)).alias("is_prefix"),
                field("length", F.lit(None)).cast("string").alias("length"),
            ),
        ).otherwise(_metadata_defaults())
    # quoted strings stay as they are; between them Python words become JSON words, and a last comma goes
    parts = F.regexp_extract_all(metadata, F.lit(QUOTED_OR_NOT), F.lit(0))

    def outside(part: Column) -> Column:
        for word, other in (("True", "true"), ("False", "false"), ("None", "null")):
            part = F.regexp_replace(part, rf"\b{word}\b", other)
        return F.regexp_replace(part, r",(\s*[}\])])", "$1")

    quoted = lambda part: part.rlike("^['\"]")
    json = F.array_join(F.transform(parts, lambda p: F.when(quoted(p), p).otherwise(outside(p))), "")
    # JSON's own words are no Python literals
    foreign = F.exists(parts, lambda p: ~quoted(p) & p.rlike(r"\b(true|false|null)\b"))
    read = F.from_json(F.when(~foreign, json), "map<string,string>", {"allowSingleQuotes": "true"})
    usable = read.isNotNull() & (F.coalesce(F.size(read), F.lit(0)) > 0)
    flag = read["is_prefix"]
    nothing = flag.isin("false", "", "[]", "{}") | F.coalesce(flag.try_cast("double") == 0, F.lit(False))
    return F.when(
        usable,
        F.struct(
            F.when(F.map_contains_key(read, "task"), read["task"]).otherwise("Other").alias("task"),
            F.when(F.map_contains_key(read, "is_prefix"), flag.isNotNull() & ~nothing)
            .otherwise(True)
            .alias("is_prefix"),
            read["length"].alias("length"),
        ),
    ).otherwise(_metadata_defaults())


def _metadata_defaults() -> Column:
    return F.struct(
        F.lit("Other").alias("task"), F.lit(True).alias("is_prefix"), F.lit(None).cast("string").alias("length")
    )


def extract_length(length: Column) -> Column:
    """Whole number from the metadata length; empty, missing or unreadable gives 0."""
    return F.coalesce(F.nullif(length, F.lit("")).try_cast("int"), F.lit(0))


def assemble_prompt(context: Column, question: Column, is_prefix: Column) -> Column:
    """Question then context when the question is a prefix, else context then question."""
    context_part = F.concat(F.lit("\n"), rstrip(context))
    question_part = F.concat(F.lit("\n"), lstrip(question))
    return F.when(is_prefix, F.concat(question_part, F.lit("\n"), context_part)).otherwise(
        F.concat(context_part, F.lit("\n"), question_part)
    )


def task_prompt_wrap(prompt: Column, task: Column) -> Column:
    return (
        F.when(task == "Summarization", F.concat(F.lit(SUMMARY_LEAD), prompt, F.lit(SUMMARY_END)))
        .when(task == "Code", F.concat(F.lit(CODE_LEAD), prompt))
        .otherwise(prompt)
    )


@dataclass(frozen=True)
class ChatTemplate:
    """How a message of a role is written, and what opens an answer."""

    prefix: str = "<|im_start|>{role}\n"
    suffix: str = "<|im_end|>\n"
    generation: str = "<|im_start|>assistant\n"


def render_message(role: str, text: Column, template: ChatTemplate) -> Column:
    return F.concat(F.lit(template.prefix.format(role=role)), text, F.lit(template.suffix))


def render_chat(messages: Column, template: ChatTemplate = ChatTemplate(), add_generation_prompt: bool = False) -> Column:
    """Text of one ``array<struct<role, content>>`` in order."""
    head, _, tail = template.prefix.partition("{role}")
    parts = F.transform(
        messages,
        lambda m: F.concat(F.lit(head), m["role"], F.lit(tail), m["content"], F.lit(template.suffix)),
    )
    text = F.array_join(parts, "")
    return F.concat(text, F.lit(template.generation)) if add_generation_prompt else text


def task_class_id(task: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in TASK_CLASSES.items() for x in pair])
    return F.coalesce(F.try_element_at(known, F.coalesce(task, F.lit(""))), F.lit(OTHER_CLASS))


def task_class_name(class_id: Column) -> Column:
    names = F.create_map(*[F.lit(x) for name, i in TASK_CLASSES.items() for x in (i, name)])
    return F.coalesce(F.try_element_at(names, class_id), F.lit(UNKNOWN_TASK))


def format_duration(seconds: Column) -> Column:
    """Seconds as ``h:mm:ss``; fractions are cut."""
    whole = F.floor(seconds)
    return F.format_string(
        "%d:%02d:%02d",
        F.floor(whole / 3600),
        F.floor(F.pmod(whole, F.lit(3600)) / 60),
        F.pmod(whole, F.lit(60)),
    )


def prefix_metric_name(name: Column, prefix: str = "eval") -> Column:
    """Add ``prefix_`` unless the name already has it."""
    head = f"{prefix}_"
    return F.when(F.startswith(name, F.lit(head)), name).otherwise(F.concat(F.lit(head), name))


def prefix_metric_map(metrics: Column, prefix: str = "eval") -> Column:
    return F.transform_keys(metrics, lambda k, _: prefix_metric_name(k, prefix))
