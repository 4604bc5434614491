"""Text column builders: tokens, sentences, normal forms, answers of models as structs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, DoubleType, FloatType, MapType, StructType

# white space as Unicode (and the four information separators) has it, in a form Java and RE2 both read
SPACE = r"[\s\x{0085}\x{00A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}\x{001C}-\x{001F}]"

# fixed values: tokens that keep identifiers such as h-1b or 214.2 whole, and plain tokens
IDENT_TOKEN = r"[a-z0-9]+(?:[-.][a-z0-9]+)*"
PLAIN_TOKEN = r"[a-z0-9]+"

# fixed values: dotted abbreviations after which no sentence ends
ABBREVIATIONS = r"[A-Z]|No|Nos|Mr|Mrs|Ms|Dr|Sr|Jr|St|vs|etc|e\.g|i\.e|approx|Fig|Jan|Feb|Mar|Apr|Jun|Jul|Aug|Sept?|Oct|Nov|Dec|U\.S|Sec|Pub|Reg"

# fixed values: stop words of answer verification and of lexical retrieval; the two lists differ on purpose
VERIFY_STOP = (
    "the a an of to in on for and or is are was were be been by as at it its that this with from than into under over "
    "their they them which who whom whose not no any all each per"
).split()
RETRIEVAL_STOP = (
    "the a an of to in on for and or is are was were be by as at it its that this with from than into under over "
    "their they them which who does do what when how many own not any"
).split()

# fixed values: denying phrases
DENIAL = (
    r"(?i)\b(?:does not|do not|did not|is not|are not|was not|were not|cannot|can't|doesn't|don't|no fixed|sets no|"
    r"not guarantee|never|rather than|instead of)\b"
)


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def strip(c: Column | str) -> Column:
    """Without outer white space of any kind."""
    return F.regexp_replace(col(c), f"^{SPACE}+|{SPACE}+$", "")


def words(c: Column | str) -> Column:
    """Maximal runs without white space; [] for null."""
    return F.coalesce(F.filter(F.split(col(c), f"{SPACE}+"), lambda w: w != ""), F.array().cast("array<string>"))


def norm(c: Column | str) -> Column:
    """Stripped, lower-cased, white space single."""
    return strip(F.regexp_replace(F.lower(col(c)), f"{SPACE}+", " "))


def ident_tokens(c: Column | str) -> Column:
    return F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(f"({IDENT_TOKEN})"), F.lit(1)), F.array().cast("array<string>"))


def plain_tokens(c: Column | str) -> Column:
    """Distinct plain tokens."""
    return F.array_distinct(F.coalesce(F.regexp_extract_all(F.lower(col(c)), F.lit(f"({PLAIN_TOKEN})"), F.lit(1)), F.array().cast("array<string>")))


def content_tokens(c: Column | str, stop: list[str]) -> Column:
    """Distinct plain tokens that aren't stop words."""
    return F.array_except(plain_tokens(c), F.array(*map(F.lit, stop)))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common elements of two sets; 0 if either is empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0.0).otherwise(both / F.greatest(union, F.lit(1)))


def sentences(c: Column | str) -> Column:
    """Stripped non-empty sentences; a stop that ends an abbreviation ends no sentence."""
    parts = F.split(col(c), rf"(?U)(?<=[.!?])(?<!\b(?:{ABBREVIATIONS})\.)\s+")
    return F.coalesce(F.filter(F.transform(parts, strip), lambda s: s != ""), F.array().cast("array<string>"))


def snippet(c: Column | str, chars: int = 160) -> Column:
    return F.left(strip(F.regexp_replace(col(c), f"{SPACE}+", " ")), F.lit(chars))


def embedding_key(model: str, c: Column | str) -> Column:
    return F.concat(F.lit(f"{model}::"), norm(c))


def unfenced(c: Column | str) -> Column:
    """Without code fences at either end."""
    return strip(F.regexp_replace(strip(c), r"^```(?:json)?|```$", ""))


def analysis(c: Column | str) -> Column:
    """A model's verdict, as JSON or as a printed dictionary, fenced or not: struct(score int, reason string).

    A quoted whole number counts as the number. What is neither gives a null score and the stripped text as reason;
    null stays null.
    """
    fields = "hallucination_score string, reason string, __odd string"
    options = {"columnNameOfCorruptRecord": "__odd", "allowBackslashEscapingAnyCharacter": "true"}

    def read(body: Column) -> Column:
        # a printed dictionary with None, True or False isn't JSON and is read by its two keys
        score = F.nullif(F.regexp_extract(body, r"""["']hallucination_score["']\s*:\s*["']?(-?\d+)""", 1), F.lit(""))
        quoted = F.nullif(F.regexp_extract(body, r"""["']reason["']\s*:\s*(?:"((?:[^"\\]|\\.)*)"|'((?:[^'\\]|\\.)*)')""", 0), F.lit(""))
        inner = F.regexp_replace(quoted, r"""^["']reason["']\s*:\s*["']|["']$""", "")
        printed = F.struct(score.alias("hallucination_score"), F.regexp_replace(inner, r"""\\(["'\\])""", "$1").alias("reason"))
        json = F.from_json(body, fields, options)
        both = F.when(json["__odd"].isNull(), F.struct(json["hallucination_score"].alias("hallucination_score"), json["reason"].alias("reason"))).otherwise(printed)
        read = F.transform(F.array(both), lambda r: F.struct(F.trim(r["hallucination_score"]).try_cast("int").alias("score"), r["reason"].alias("reason")))[0]
        other = F.struct(F.lit(None).cast("int").alias("score"), strip(c).alias("reason"))
        return F.when(body.startswith("{") & body.endswith("}"), read).otherwise(other)

    # the unfenced text is bound once, by a one-element transform
    return F.when(col(c).isNotNull(), F.transform(F.array(unfenced(c)), read)[0])


# fixed value: the reason of an answer without a verdict
NO_ANALYSIS = "No hallucination analysis returned."


def analysis_or_text(df: DataFrame, name: str) -> Column:
    """struct(score string, reason string) of a verdict that may be a struct, a JSON object as text, or neither.

    A struct with ``hallucination_score`` and ``reason`` is taken as it is; text that is no strict JSON object becomes
    the reason, unstripped, with a null score; null gives a fixed reason.
    """
    kind = df.schema[name].dataType
    c = F.col(f"`{name}`")
    pair = lambda score, reason: F.struct(score.cast("string").alias("score"), reason.cast("string").alias("reason"))
    nothing = pair(F.lit(None), F.lit(NO_ANALYSIS))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), pair(c["hallucination_score"], c["reason"])).otherwise(nothing)
    options = {"columnNameOfCorruptRecord": "__odd", "allowSingleQuotes": "false"}

    def read(json: Column) -> Column:
        return F.when(c.rlike(r"^\s*\{") & json["__odd"].isNull(), pair(json["hallucination_score"], json["reason"])).otherwise(pair(F.lit(None), c))

    parsed = F.transform(F.array(F.from_json(c, "hallucination_score string, reason string, __odd string", options)), read)[0]
    return F.when(c.isNotNull(), parsed).otherwise(nothing)


def verdict(c: Column | str) -> Column:
    """A known verdict in lower case, else 'baseless'."""
    v = F.lower(strip(c))
    return F.when(v.isin("entailed", "contradicted", "baseless"), v).otherwise("baseless")


def feedback_label(c: Column | str) -> Column:
    """1 for feedback that says correct, else 0."""
    return F.when(F.lower(strip(c)) == "correct", 1).otherwise(0)


def finite(c: Column | str) -> Column:
    """Null in place of NaN and the infinities, in a number."""
    x = col(c)
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def finite_all(c: Column, kind: DataType) -> Column:
    """The same in every double of a value of type ``kind``, however deep in arrays, structs and maps; map keys become text."""
    if isinstance(kind, DoubleType | FloatType):
        return finite(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: finite_all(x, kind.elementType))
    if isinstance(kind, MapType):
        values = F.transform_values(c, lambda _, v: finite_all(v, kind.valueType))
        return F.transform_keys(values, lambda k, _: k.cast("string"))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(finite_all(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def finite_row(df: DataFrame) -> DataFrame:
    """``df`` with every column so cleaned, as JSON has no such numbers."""
    return df.select(*(finite_all(F.col(f"`{f.name}`"), f.dataType).alias(f.name) for f in df.schema.fields))


def denies(c: Column | str) -> Column:
    return F.coalesce(col(c).rlike(DENIAL), F.lit(False))


def context_block(title: Column, text: Column) -> Column:
    """One source as it stands in a prompt."""
    return F.concat(F.lit("Source: "), title, F.lit("\nText: "), text)


def window_block(number: Column, title: Column, text: Column) -> Column:
    """One numbered window as it stands in a prompt of local verification."""
    return F.concat(F.lit("WINDOW "), number.cast("string"), F.lit(": (Source: "), title, F.lit(")\n"), text)


def full_block(title: Column, text: Column) -> Column:
    """One source as it stands in a prompt of global verification."""
    return F.concat(F.lit("(Source: "), title, F.lit(")\n"), text)
