"""Column functions on text. White space and word classes are Unicode's, as written with (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StringType, StructType


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.regexp_replace(F.regexp_replace(c, r"(?U)\s+", " "), "^ | $", "")


def excerpt(c: Column, n: int = 120) -> Column:
    s = squeeze(c)
    return F.when(F.length(s) > n, F.concat(F.left(s, F.lit(n)), F.lit("…"))).otherwise(s)


def contains_loosely(a: Column, b: Column) -> Column:
    """Whether a contains b, white space aside."""
    bare = lambda x: F.regexp_replace(x, r"(?U)\s+", "")
    return F.contains(bare(a), bare(b))


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def sentences(c: Column, terminators: str = "。！？；", newline: bool = False) -> Column:
    """Parts that end in a terminator, trimmed and not empty; a newline ends one, too, if asked."""
    cut = f"(?<=[{terminators}])" + (r"|\n" if newline else "")
    return F.filter(F.transform(F.split(c, cut), strip), lambda x: x != "")


def numbers(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(r"[0-9]+(?:\.[0-9]+)?"), F.lit(0))


def receipts(c: Column) -> Column:
    """Receipt numbers, white space aside."""
    return F.regexp_extract_all(F.regexp_replace(c, r"(?U)\s+", ""), F.lit(r"(?U)\b[RD]\d{4,}\b"), F.lit(0))


#: Patterns of personal data and what stands for a whole match, in this order (an identity number would
#: else be taken for a bank card).
MASKS = (
    (r"[1-9]\d{5}(?:19|20)\d{2}(?:0[1-9]|1[0-2])(?:0[1-9]|[12]\d|3[01])\d{3}[\dXx]", "<id-card>"),
    (r"\b\d{16,19}\b", "<bank-card>"),
    (r"1[3-9]\d{9}", "<phone>"),
    (r"[\w.+-]+@[\w-]+\.[\w.-]+", "<email>"),
)


def mask(c: Column) -> Column:
    """Personal data replaced by its kind, each rule over what the ones before left."""
    for pattern, name in MASKS:
        c = F.regexp_replace(c, "(?U)" + pattern, name)
    return c


def mask_within(c: Column, kind: DataType) -> Column:
    """A column of any type with all text in it masked: in arrays, struct fields and map values; map keys stay."""
    if isinstance(kind, StringType):
        return mask(c)
    if isinstance(kind, ArrayType):
        return F.transform(c, lambda x: mask_within(x, kind.elementType))
    if isinstance(kind, MapType):
        return F.transform_values(c, lambda _, v: mask_within(v, kind.valueType))
    if isinstance(kind, StructType):
        return F.when(c.isNotNull(), F.struct(*(mask_within(c[f.name], f.dataType).alias(f.name) for f in kind.fields)))
    return c


def salted(c: Column, salt: str) -> Column:
    return F.substring(F.sha2(F.concat(F.lit(salt + ":"), c.cast("string")), 256), 1, 16)


def token_count(c: Column) -> Column:
    """A tokenizer's stand-in: ideographs one by one, and other words."""
    ideographs = F.size(F.regexp_extract_all(c, F.lit(r"[\x{4e00}-\x{9fff}]"), F.lit(0)))
    words = F.size(F.filter(F.split(F.regexp_replace(c, r"[\x{4e00}-\x{9fff}]", " "), r"(?U)\s+"), lambda x: x != ""))
    return ideographs + words


#: Characters without a meaning of their own; a pair of two of them is no term.
FUNCTION_CHARS = "的了着过吗呢吧啊呀么是不在有和与或及对为以之其这那些我你他她它们个就都还也很要会能可把被给让从到"


def terms(c: Column) -> Column:
    """Distinct terms: Latin words and numbers whole, of ideographs each pair of neighbours, alone where one stands alone."""
    plain = lambda x: F.instr(F.lit(FUNCTION_CHARS), x) > 0
    at = lambda t, i: F.substring(t, i, F.lit(1))
    pair = lambda t: F.transform(F.sequence(F.lit(1), F.length(t) - 1), lambda i: F.when(~(plain(at(t, i)) & plain(at(t, i + 1))), F.substring(t, i, F.lit(2))))
    one = lambda t: F.array(F.when(~plain(t), t))
    of = lambda t: F.when(t.rlike("^[0-9a-z]"), F.array(t)).when(F.length(t) == 1, one(t)).otherwise(pair(t))
    found = F.regexp_extract_all(F.lower(c), F.lit(r"[0-9]+(?:\.[0-9]+)?|[a-z]+|[\x{4e00}-\x{9fff}]+"), F.lit(0))
    return F.array_distinct(F.array_compact(F.flatten(F.transform(found, of))))
