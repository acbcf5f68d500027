"""Column expressions over a text column (tokens, sentences, run-length counts).

Everything here but ``char_entropy`` (an Arrow function over batches) is a
built-in Spark expression evaluated inside the row: per-document statistics
never shuffle the text.
Null text is treated as the empty string (SURVEY 1.5 decision).

Regex classes are written so that Java and RE2 (the oracle) read them the
same way and agree with Python's Unicode rules.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The characters Python's str.isspace() accepts, as one class body.
WS_BODY = r"\t-\r\x{1c}-\x{20}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"
WS_RUN = f"[{WS_BODY}]+"
NON_WS = f"[^{WS_BODY}]"
SENT_SPLIT = "[.!?]+"
WORD_CHAR = r"[\p{L}\p{N}_]"


def text_or_empty(c: str | Column) -> Column:
    col = F.col(c) if isinstance(c, str) else c
    return F.coalesce(col, F.lit(""))


NON_WS_RUN = f"({NON_WS}+)"
# The same whitespace set as WS_BODY, as characters, without the plain space.
WS_OTHER = ("\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f\x85\xa0\u1680"
            + "".join(chr(c) for c in range(0x2000, 0x200B)) + "\u2028\u2029\u202f\u205f\u3000")


def normalize_ws(t: Column) -> Column:
    """Every whitespace character becomes a plain space (a native per-character mapping)."""
    return F.translate(t, WS_OTHER, " " * len(WS_OTHER))


def words(t: Column) -> Column:
    """W: Python ``str.split()``: the maximal runs of non-whitespace characters.

    Whitespace is mapped to spaces, split on one space (Java's single
    character fast path, no regex) and the empty pieces between adjacent
    spaces are dropped with ``array_remove`` (native, no lambda).
    """
    return words_normalized(normalize_ws(t))


def words_normalized(tn: Column) -> Column:
    """W of a text whose whitespace is already plain spaces."""
    return F.array_remove(F.split(tn, " "), "")


def sentences_normalized(tn: Column) -> Column:
    """S of a whitespace-normalised text: pieces of ``[.!?]+`` holding a non-space character."""
    return F.filter(F.split(tn, SENT_SPLIT), lambda s: s.rlike("[^ ]"))


def first_token_normalized(s: Column) -> Column:
    """First word of a whitespace-normalised piece holding a non-space character."""
    return F.substring_index(F.trim(s), " ", 1)


def lower_words(t: Column) -> Column:
    """L: ``str.lower().split()``."""
    return words(F.lower(t))


def sentences(t: Column) -> Column:
    """S: pieces of ``re.split('[.!?]+')`` holding a non-space character."""
    return F.filter(F.split(t, SENT_SPLIT), lambda s: s.rlike(NON_WS))


def lengths(arr: Column) -> Column:
    return F.transform(arr, lambda w: F.length(w))


def sentence_word_counts(sents: Column) -> Column:
    """Words per sentence of whitespace-normalised sentences."""
    return F.transform(sents, lambda s: F.size(words_normalized(s)))


def arr_sum(arr: Column) -> Column:
    return F.aggregate(arr, F.lit(0).cast("long"), lambda a, x: a + x)


# Lambdas below only read their own variables: Spark evaluates any outer
# expression inside a lambda once per element, which would make a
# per-document statistic quadratic in the document length.

def with_pop_var(df: DataFrame, arr_col: str, out: str) -> DataFrame:
    """Adds the population variance of an integer array, exact: (n*sum(x^2) - sum(x)^2) / n^2; null when empty. Each sum is a
    column of its own, so it is computed once per row."""
    s, q = f"{out}_s", f"{out}_q"
    df = df.withColumn(s, arr_sum(F.col(arr_col))).withColumn(
        q, F.aggregate(arr_col, F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x))
    n = F.size(arr_col).cast("long")
    return df.withColumn(out, F.when(n > 0, (n * F.col(q) - F.col(s) * F.col(s)).cast("double") / (n * n).cast("double"))).drop(s, q)


def run_mask(sorted_arr: Column) -> Column:
    """``true`` where a sorted array starts a new run of equal (non-null) values."""
    n = F.size(sorted_arr)
    prev = F.slice(F.concat(F.array(F.lit(None).cast("string")), sorted_arr.cast("array<string>")), 1, n)
    return F.zip_with(sorted_arr.cast("array<string>"), prev, lambda x, p: p.isNull() | (x != p))


def with_value_counts(df: DataFrame, arr_col: str, prefix: str) -> DataFrame:
    """Add ``<prefix>_terms`` (distinct values, sorted) and ``<prefix>_tf`` (their counts), in-row.

    Sort, mark run starts, take the gaps between consecutive starts. Each
    intermediate array is its own column, so it is computed once per row.
    """
    s, m, st = f"{prefix}_s", f"{prefix}_m", f"{prefix}_st"
    df = df.withColumn(s, F.sort_array(F.col(arr_col)))
    df = df.withColumn(m, run_mask(F.col(s)))
    df = df.withColumn(st, F.filter(F.transform(F.col(m), lambda b, i: F.when(b, i).otherwise(F.lit(-1))),
                                    lambda i: i >= 0))
    n_st = F.size(F.col(st))
    ends = F.concat(F.slice(F.col(st), 2, F.greatest(n_st - 1, F.lit(0))), F.array(F.size(F.col(s))))
    df = df.withColumn(f"{prefix}_tf", F.when(n_st > 0, F.zip_with(ends, F.col(st), lambda e, b: e - b))
                       .otherwise(F.array().cast("array<int>")))
    df = df.withColumn(f"{prefix}_terms", F.filter(F.zip_with(F.col(s), F.col(m), lambda x, b: F.when(b, x)),
                                                   lambda x: x.isNotNull()))
    return df.drop(s, m, st)


SLICE_CHARS = 1 << 20  # characters counted at a time; a longer text stands alone
TABLE_CELLS = 1 << 23  # of a table of counts by text and character


def char_entropy(t: Column) -> Column:
    """Shannon entropy (base 2) of the characters of a non-null text, 0 when empty: counted for a slice of texts at a time."""
    def entropies(column):
        import numpy as np
        import pyarrow as pa

        texts = column.to_pylist()
        size = np.array([len(x) for x in texts], np.int64)
        ends = np.cumsum(size)
        out, lo = np.zeros(len(texts)), 0
        while lo < len(texts):
            hi = max(int(np.searchsorted(ends, ends[lo] - size[lo] + SLICE_CHARS, "right")), lo + 1)
            out[lo:hi] = _entropies("".join(texts[lo:hi]), size[lo:hi])
            lo = hi
        return pa.array(out)

    return F.arrow_udf(entropies, "double")(t)


def _entropies(joined: str, size):
    """The entropies of texts of ``size`` characters that stand side by side in ``joined``; a text's terms add up by code point."""
    import numpy as np

    chars = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    if not len(chars):
        return np.zeros(len(size))
    seen = np.zeros(int(chars.max()) + 1, bool)
    seen[chars] = True
    n = int(seen.sum())
    key = np.repeat(np.arange(len(size)) * n, size) + (np.cumsum(seen) - 1)[chars]
    if len(size) * n <= TABLE_CELLS:
        c = np.bincount(key, minlength=len(size) * n)
        pair = np.flatnonzero(c)
        c = c[pair]
    else:
        pair, c = np.unique(key, return_counts=True)
    doc = pair // n
    p = c / size[doc]
    return np.bincount(doc, -p * np.log2(p + 1e-12), len(size))


def count_matches(t: Column, pattern: str) -> Column:
    return F.regexp_count(t, F.lit(pattern))


def first_token(s: Column) -> Column:
    return F.element_at(words(s), 1)
