"""TF-IDF inside the row (TF-5, P-9, SV-1): vocabularies held by every task, documents never exploded by term.

``fit`` counts, ``weigh`` weighs; both read each text once, whatever the number of folds. A term's counts are kept by fold, so
the train part of fold ``k`` is the total less its own part, and a term becomes an array of per-fold idf. The vocabulary is
bounded by ``max_features`` per fold; it travels to the tasks, and a document's weights for every fold it takes part in come
out of its own row.

Analyzers give a batch's term codes as arrays: words arrive as an array column, characters as the padded words side by side,
and n-grams are cut here, as shifted views of all words or code points of a slice (a code is the places of the n symbols among
the slice's symbols).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from ..session import DEFAULT_BROADCAST_ROWS, materialize
from .tfidf import word_tokens

SLICE_BYTES = 1 << 20  # of terms or text that a task turns into arrays at a time


@dataclass(frozen=True)
class Analyzer:
    """``kind`` 'words' (``n_min..n_max`` word n-grams without ``stop_words``) or 'chars' (n-grams inside padded words)."""

    kind: str
    n_min: int
    n_max: int
    stop_words: tuple[str, ...] = ()

    def prepared(self, df: DataFrame, text: Column, out: str) -> DataFrame:
        """Adds the column that tasks read: the words, or the padded words side by side."""
        if self.kind == "words":
            return df.withColumn(out, word_tokens(text, self.stop_words))
        return df.withColumn(out, F.concat(F.lit(" "), F.array_join(T.words(F.lower(text)), "  "), F.lit(" ")))

    def codes(self, column) -> "_Codes":
        """The term occurrences of an Arrow column slice."""
        return (_word_codes if self.kind == "words" else _char_codes)(column, self.n_min, self.n_max)


@dataclass
class _Codes:
    """Occurrences ``(doc, code)``, codes below ``bound``; ``terms`` names ascending codes, ``find`` gives the code of each wanted
    term (-1: not there)."""

    doc: np.ndarray
    code: np.ndarray
    bound: int
    terms: object
    find: object


def _grams(doc: np.ndarray, group: np.ndarray, symbol: np.ndarray, base: int, n_min: int, n_max: int) -> tuple[np.ndarray, np.ndarray]:
    """``(doc, code)`` of the n-grams of consecutive symbols (from 1, below ``base``) inside a group: a code has them as digits."""
    docs, codes, code = [], [], symbol
    for n in range(1, n_max + 1):
        if n > 1:
            code = code[:-1] * base + symbol[n - 1:]
        if n >= n_min and len(code):
            inside = group[:len(code)] == group[n - 1:]
            docs.append(doc[:len(code)][inside])
            codes.append(code[inside])
    none = np.zeros(0, np.int64)
    return np.concatenate(docs) if docs else none, np.concatenate(codes) if codes else none


def _symbols(codes: np.ndarray, base: int, n_max: int) -> Iterator[np.ndarray]:
    """The symbols (from 0) of ascending codes, a matrix for each length; longer terms have larger codes."""
    ends = np.searchsorted(codes, np.array([base ** n for n in range(n_max + 1)], object).astype(np.int64))
    for n in range(1, n_max + 1):
        of_n = codes[ends[n - 1]:ends[n]]
        yield np.stack([of_n // base ** (n - 1 - k) % base - 1 for k in range(n)], axis=1)


def _string_codes(terms: list[str]) -> _Codes:
    """The terms of a single document."""
    import pyarrow as pa
    import pyarrow.compute as pc

    coded = pa.array(terms, pa.string()).dictionary_encode()
    words = coded.dictionary

    def find(wanted) -> np.ndarray:
        return pc.fill_null(pc.index_in(wanted, value_set=words), -1).to_numpy(zero_copy_only=False).astype(np.int64)

    return _Codes(np.zeros(len(terms), np.int64), coded.indices.to_numpy(zero_copy_only=False).astype(np.int64), max(len(words), 1),
                  lambda codes: words.take(pa.array(codes)), find)


def _word_codes(column, n_min: int, n_max: int) -> _Codes:
    """Codes of all n-grams of the words of some texts, words numbered within the slice."""
    import pyarrow as pa
    import pyarrow.compute as pc

    size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    coded = column.flatten().dictionary_encode()
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
    words = coded.dictionary
    base = len(words) + 1
    if base ** n_max >= 1 << 63:
        if len(column) > 1:
            raise OverflowError("words of a slice")  # callers halve the slice
        own = column.flatten().to_pylist()
        return _string_codes([" ".join(own[i:i + n]) for n in range(n_min, n_max + 1) for i in range(len(own) - n + 1)])
    doc = np.repeat(np.arange(len(column)), size)
    doc, code = _grams(doc, doc, coded.indices.to_numpy(zero_copy_only=False).astype(np.int64) + 1, base, n_min, n_max)

    def terms(codes: np.ndarray):
        return pa.concat_arrays([pa.array([], pa.string()), *[
            pc.binary_join_element_wise(*[words.take(pa.array(x)) for x in m.T], " ").cast(pa.string()) for m in _symbols(codes, base, n_max)]])

    def find(wanted) -> np.ndarray:
        parts = [t.split(" ") for t in wanted.to_pylist()]
        place = pc.fill_null(pc.index_in(pa.array([w for p in parts for w in p], pa.string()), value_set=words), -1).to_numpy(zero_copy_only=False)
        out, at = np.zeros(len(parts), np.int64), 0
        for j, p in enumerate(parts):
            x = 0
            for k in place[at:at + len(p)].tolist():
                x = x * base + k + 1 if x >= 0 and k >= 0 else -1
            out[j], at = x, at + len(p)
        return out

    return _Codes(doc, code, base ** n_max, terms, find)


def _char_codes(column, n_min: int, n_max: int) -> _Codes:
    """Codes of all n-grams of the padded words of some texts, characters numbered within the slice. Any alphabet whose
    ``n_max``-th power fits 63 bits is exact."""
    import pyarrow as pa

    texts = [t or "" for t in column.to_pylist()]
    size = np.array([len(t) for t in texts], np.int64)
    chars = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    alphabet = np.unique(chars)
    base = len(alphabet) + 1
    if base ** n_max >= 1 << 63:
        if len(texts) > 1:
            raise OverflowError("alphabet of a slice")  # callers halve the slice
        words = [f" {w} " for w in texts[0].split(" ") if w]
        return _string_codes([w[i:i + n] for w in words for n in range(n_min, n_max + 1) for i in range(len(w) - n + 1)])
    doc = np.repeat(np.arange(len(texts)), size)
    # words are padded by one space each, so two adjacent spaces are the border of two words
    space = chars == 32
    starts = space.copy()
    starts[1:] &= space[:-1]
    edge = np.cumsum(size) - size
    starts[edge[size > 0]] = True
    doc, code = _grams(doc, np.cumsum(starts), np.searchsorted(alphabet, chars).astype(np.int64) + 1, base, n_min, n_max)

    def terms(codes: np.ndarray):
        out = []
        for m in _symbols(codes, base, n_max):
            n, all_chars = m.shape[1], alphabet[m].tobytes().decode("utf-32-le", "surrogatepass")
            out += [all_chars[k:k + n] for k in range(0, len(all_chars), n)]
        return pa.array(out, pa.string())

    place = {chr(c): k + 1 for k, c in enumerate(alphabet.tolist())}

    def pack(term: str) -> int:
        x = 0
        for c in term:
            if c not in place:
                return -1
            x = x * base + place[c]
        return x

    return _Codes(doc, code, base ** n_max, terms, lambda wanted: np.array([pack(t) for t in wanted.to_pylist()], np.int64))


def _starts(ordered: np.ndarray) -> np.ndarray:
    """Where the runs of equal values start."""
    new = np.ones(len(ordered), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    return np.flatnonzero(new)


def _slices(batch, columns: Sequence[str]) -> Iterator:
    """Runs of rows of a batch whose prepared columns stay near ``SLICE_BYTES`` (a longer text stands alone)."""
    n, per_row = batch.num_rows, np.zeros(batch.num_rows)
    for c in columns:
        per_row += _bytes(batch.column(c))
    lo, total = 0, 0.0
    for k in range(n):
        if k > lo and total + per_row[k] > SLICE_BYTES:
            yield batch.slice(lo, k - lo)
            lo, total = k, 0.0
        total += per_row[k]
    if lo < n:
        yield batch.slice(lo, n - lo)


def _bytes(column) -> np.ndarray:
    import pyarrow as pa
    import pyarrow.compute as pc

    if pa.types.is_list(column.type):
        return 8.0 * pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)
    return pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(float)


def _halving(batch, read) -> Iterator:
    """``read(batch)``, in halves where a slice has too many different characters for its codes."""
    try:
        out = read(batch)
    except OverflowError:
        mid = batch.num_rows // 2
        yield from _halving(batch.slice(0, mid), read)
        yield from _halving(batch.slice(mid), read)
    else:
        yield out


# ---------------------------------------------------------------- fit

@dataclass
class Vocabulary:
    """``idf[term, fold]``, NaN where the term is not in that fold's vocabulary; terms ascend, so do the slots of a fold."""

    analyzer: Analyzer
    terms: list[str]
    idf: np.ndarray
    slots: np.ndarray = field(init=False)

    def __post_init__(self) -> None:
        self.slots = np.cumsum(~np.isnan(self.idf), axis=0) - 1

    def size(self, k: int) -> int:
        return int((~np.isnan(self.idf[:, k])).sum())


def _counts(docs: DataFrame, column: str, analyzer: Analyzer, fold: str) -> DataFrame:
    """``(term, fold, df, ctf)`` of each slice, still to be added up."""
    import pyarrow as pa

    def work(it):
        for whole in it:
            for part in _slices(whole, [column]):
                for b, c in _halving(part, lambda b: (b, analyzer.codes(b.column(column)))):
                    if not len(c.code):
                        continue
                    folds = b.column(fold).to_numpy(zero_copy_only=False).astype(np.int64)
                    n, n_folds, code, names = b.num_rows, int(folds.max()) + 1, c.code, None
                    if c.bound * n_folds * n >= 1 << 63:
                        names, code = np.unique(code, return_inverse=True)
                    x = np.sort((code * n_folds + folds[c.doc]) * n + c.doc)
                    pair = _starts(x)  # of a term and a document
                    tf, x = np.diff(pair, append=len(x)), x[pair] // n
                    group = _starts(x)  # of a term and a fold
                    df, ctf = np.diff(group, append=len(x)), np.add.reduceat(tf, group)
                    code, k = np.divmod(x[group], n_folds)
                    code = code if names is None else names[code]
                    yield pa.RecordBatch.from_arrays([c.terms(code), pa.array(k, pa.int32()), pa.array(df, pa.int64()), pa.array(ctf)],
                                                     ["term", "fold", "df", "ctf"])

    return docs.select(F.col(fold).cast("int").alias(fold), column).mapInArrow(work, "term string, fold int, df long, ctf long")


def term_counts(docs: DataFrame, text: Column, analyzer: Analyzer) -> DataFrame:
    """``(term, df, ctf)`` of slices of the documents, still to be added up."""
    return _counts(analyzer.prepared(docs.withColumn("_fold", F.lit(0)), text, "_terms"), "_terms", analyzer, "_fold").drop("fold")


def doc_terms(docs: DataFrame, text: Column, analyzer: Analyzer, keep: Sequence[str]) -> DataFrame:
    """``(keep..., term, tf)`` of every document."""
    import pyarrow as pa

    def work(it):
        for whole in it:
            for part in _slices(whole, ["_terms"]):
                for b, c in _halving(part, lambda b: (b, analyzer.codes(b.column("_terms")))):
                    kinds, code = np.unique(c.code, return_inverse=True)
                    pair, tf = np.unique(c.doc * max(len(kinds), 1) + code, return_counts=True)
                    doc, code = np.divmod(pair, max(len(kinds), 1))
                    yield pa.RecordBatch.from_arrays([*[b.column(x).take(pa.array(doc)) for x in keep], c.terms(kinds).take(pa.array(code)), pa.array(tf, pa.int64())],
                                                     [*keep, "term", "tf"])

    t = analyzer.prepared(docs, text, "_terms").select(*keep, "_terms")
    return t.mapInArrow(work, t.select(*keep, F.lit("").alias("term"), F.lit(0).cast("long").alias("tf")).schema)


def fit(docs: DataFrame, text: Column, analyzer: Analyzer, n_folds: int = 0, fold_col: str | None = None, min_df: int = 1,
        max_df: float = 1.0, max_features: int = 3000) -> Vocabulary:
    """Vocabulary and idf of the documents, for each fold of the rows outside it (``n_folds`` 0: one, of all rows).

    Folds are ``0..n_folds-1``. Terms in at least ``min_df`` and at most ``max_df`` of the part's documents, of these the
    ``max_features`` most frequent (ties by term). Folds are never looped over: their parts are columns of one aggregate.
    """
    k_all = max(n_folds, 1)
    rows = docs.withColumn("_fold", F.col(fold_col) if n_folds else F.lit(0))
    n_of = {r["_fold"]: r["n"] for r in rows.groupBy("_fold").agg(F.count(F.lit(1)).alias("n")).collect()}  # folds rows
    total = sum(n_of.values())
    n_part = [total - n_of.get(k, 0) for k in range(n_folds)] if n_folds else [total]
    by_term = _counts(analyzer.prepared(rows, text, "_terms"), "_terms", analyzer, "_fold").groupBy("term").agg(
        F.sum("df").alias("df"), F.sum("ctf").alias("ctf"),
        *[F.coalesce(F.sum(F.when(F.col("fold") == k, F.col(c))), F.lit(0)).alias(f"{c}_{k}") for k in range(n_folds) for c in ("df", "ctf")])
    own = lambda c, k: F.col(f"{c}_{k}") if n_folds else F.lit(0)
    parts = F.array(*[F.struct(F.lit(k).alias("k"), (F.col("df") - own("df", k)).alias("df"), (F.col("ctf") - own("ctf", k)).alias("ctf"),
                               F.lit(n_part[k]).alias("n")) for k in range(k_all)])
    # a part never has more documents with a term than all of them, so rare terms go before they are spread over the folds
    st = by_term.where(F.col("df") >= max(min_df, 1)).select("term", F.explode(parts).alias("p")).select("term", "p.*") \
        .where((F.col("df") >= max(min_df, 1)) & (F.col("df") <= F.lit(float(max_df)) * F.col("n")))
    top = top_by_group(st, "k", "ctf", "term", max_features)
    idf = F.log((F.lit(1.0) + F.col("n")) / (F.lit(1.0) + F.col("df"))) + F.lit(1.0)
    chosen = top.select("term", "k", idf.alias("idf")).collect()  # at most max_features rows per fold
    terms = sorted({r["term"] for r in chosen})
    place = {t: i for i, t in enumerate(terms)}
    table = np.full((len(terms), k_all), np.nan)
    for r in chosen:
        table[place[r["term"]], r["k"]] = r["idf"]
    return Vocabulary(analyzer, terms, table)


def top_by_group(rows: DataFrame, group: str, size: str, tie: str, n: int) -> DataFrame:
    """The ``n`` rows of each group with the largest ``size``, ties by ascending ``tie``: tasks keep their own first ``n`` of every
    group as rows pass, so no group is sorted or written, and only these meet."""
    import pyarrow as pa
    import pyarrow.compute as pc

    def best(it):
        held: dict = {}
        order = [(size, "descending"), (tie, "ascending")]
        for b in it:
            t = pa.Table.from_batches([b])
            for g in t.column(group).unique().to_pylist():
                held.setdefault(g, []).append(t.filter(pc.equal(t.column(group), g)))
                if sum(x.num_rows for x in held[g]) > 4 * n + 10_000:
                    held[g] = [pa.concat_tables(held[g]).sort_by(order).slice(0, n)]
        for parts in held.values():
            yield from pa.concat_tables(parts).sort_by(order).slice(0, n).to_batches()

    t = rows.mapInArrow(best, rows.schema)
    r = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(size), tie))  # at most n rows per task
    return t.withColumn("_r", r).where(F.col("_r") <= n).drop("_r")


# ---------------------------------------------------------------- weigh

def _weights(c: _Codes, vocab: Vocabulary, wanted, n_docs: int, sublinear: bool):
    """``(doc, term, tf weight)`` of the occurrences in the vocabulary, by document, then term."""
    code_of = c.find(wanted)
    known = np.flatnonzero(code_of >= 0)
    known = known[np.argsort(code_of[known])]
    if not len(known):
        none = np.zeros(0, np.int64)
        return none, none, none.astype(float)
    codes = code_of[known]
    at = np.minimum(np.searchsorted(codes, c.code), len(codes) - 1)
    keep = codes[at] == c.code
    n = len(vocab.terms)
    pair, tf = np.unique(c.doc[keep] * n + known[at[keep]], return_counts=True)
    doc, term = np.divmod(pair, n)
    return doc, term, (1.0 + np.log(tf)) if sublinear else tf.astype(float)


def _of_fold(vocab: Vocabulary, k: int, doc, term, tf, n_docs: int, normalised: bool = True):
    """``(doc, slot, term, weight)`` of one fold, L2-normalised by document."""
    idf = vocab.idf[term, k]
    keep = ~np.isnan(idf)
    doc, term, w = doc[keep], term[keep], tf[keep] * idf[keep]
    if normalised:
        w = w / np.sqrt(np.bincount(doc, w * w, n_docs))[doc]
    return doc, vocab.slots[term, k], term, w


def weigh(docs: DataFrame, text: Column, vocab: Vocabulary, keep: Sequence[str], folds: Sequence[int] = (0,), sublinear: bool = True,
          normalised: bool = True) -> DataFrame:
    """``(keep..., fold, terms array<string>, tfidf array<double>)``: a row per document and fold, empty without terms."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(vocab)

    def work(it):
        v = held.value
        wanted = pa.array(v.terms, pa.string())
        for whole in it:
            for part in _slices(whole, ["_terms"]):
                for b, c in _halving(part, lambda b: (b, v.analyzer.codes(b.column("_terms")))):
                    n = b.num_rows
                    hits = _weights(c, v, wanted, n, sublinear)
                    for k in folds:
                        doc, _, term, w = _of_fold(v, k, *hits, n, normalised)
                        ends = pa.array(np.searchsorted(doc, np.arange(n + 1)), pa.int32())
                        yield pa.RecordBatch.from_arrays(
                            [*[b.column(x) for x in keep], pa.array(np.full(n, k), pa.int32()), pa.ListArray.from_arrays(ends, wanted.take(pa.array(term))),
                             pa.ListArray.from_arrays(ends, pa.array(w))], [*keep, "fold", "terms", "tfidf"])

    t = vocab.analyzer.prepared(docs, text, "_terms").select(*keep, "_terms")
    schema = t.select(*keep, F.lit(0).alias("fold"), F.array(F.lit("")).alias("terms"), F.array(F.lit(0.0)).alias("tfidf")).schema
    return t.mapInArrow(work, schema)


def weigh_terms(docs: DataFrame, text: Column, vocab: Vocabulary, id_col: str, keep: Sequence[str] = (), sublinear: bool = True) -> DataFrame:
    """``(id, keep..., term, tfidf)``, L2-normalised over all rows of an id: in the row, and only for the rows of an id that
    comes more than once (null is an id like any other) over their exploded terms."""
    cols = [id_col, *keep]

    def terms(part: DataFrame, normalised: bool) -> DataFrame:
        e = F.explode(F.arrays_zip(F.col("terms").alias("term"), F.col("tfidf").alias("tfidf"))).alias("_e")
        return weigh(part, text, vocab, cols, (0,), sublinear, normalised).select(*cols, e).select(*cols, "_e.term", "_e.tfidf")

    again = materialize(docs.groupBy(F.col(id_col).alias("_again")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > 1).select("_again"))
    n_again = again.count()
    if not n_again:
        return terms(docs, True)
    again = F.broadcast(again) if n_again <= DEFAULT_BROADCAST_ROWS else again
    same = F.col(id_col).eqNullSafe(F.col("_again"))
    norm = F.sqrt(F.sum(F.col("tfidf") * F.col("tfidf")).over(Window.partitionBy(id_col)))
    shared = terms(docs.join(again, same, "left_semi"), False).select(*cols, "term", (F.col("tfidf") / norm).alias("tfidf"))
    return terms(docs.join(again, same, "left_anti"), True).unionByName(shared)


def count_blocks(docs: DataFrame, text: Column, vocabs: Sequence[Vocabulary], dense: Sequence[str], slot: str | None, keep: Sequence[str]) -> DataFrame:
    """What ``sparse_features`` needs of the documents, a row per slice of them: ``keep`` as lists, the columns ``dense`` (null and
    NaN are 0), ``slot`` and the packed counts of each vocabulary's terms. Texts are read once for all folds."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(list(vocabs))
    names = [f"_terms{j}" for j in range(len(vocabs))]
    lists = [*keep, "_dense", "_slot"]

    def work(it):
        wanted = [pa.array(v.terms, pa.string()) for v in held.value]
        for whole in it:
            for part in _slices(whole, names):
                for b, codes in _halving(part, lambda b: (b, [v.analyzer.codes(b.column(c)) for v, c in zip(held.value, names)])):
                    ends = pa.array([0, b.num_rows], pa.int32())
                    hits = [_pack(*_weights(c, v, w, b.num_rows, sublinear=False), b.num_rows) for v, c, w in zip(held.value, codes, wanted)]
                    yield pa.RecordBatch.from_arrays([*[pa.ListArray.from_arrays(ends, b.column(c)) for c in lists], pa.array([hits], pa.list_(pa.binary()))],
                                                     [*lists, "hits"])

    t = docs
    for v, c in zip(vocabs, names):
        t = v.analyzer.prepared(t, text, c)
    zero = F.lit(0.0)
    t = t.select(*keep, *names, F.array(*[F.coalesce(F.col(c).cast("double"), zero) for c in dense]).cast("array<double>").alias("_dense"),
                 (F.col(slot).cast("long") if slot else F.lit(None).cast("long")).alias("_slot"))
    schema = t.select(*[F.array(c).alias(c) for c in lists], F.array(F.lit(b"")).alias("hits")).schema
    return t.mapInArrow(work, schema)


def block_features(blocks: DataFrame, vocabs: Sequence[Vocabulary], n_dense: int, n_slots: int, keep: Sequence[str], fold: int = 0,
                   where: tuple[str, Sequence] | None = None, sublinear: bool = True, out: str = "features") -> DataFrame:
    """P-9: the rows of ``count_blocks`` as sparse vectors of the fold ``fold``; ``keep`` columns stay.

    ``where``: a column of the blocks and the values (None: null) of the rows to take; default all.
    """
    import pyarrow as pa
    from pyspark.ml.linalg import VectorUDT
    from pyspark.sql.types import StructField, StructType

    held = blocks.sparkSession.sparkContext.broadcast(list(vocabs))
    starts = offsets(vocabs, n_dense, n_slots, fold)
    vector = pa.struct([("type", pa.int8()), ("size", pa.int32()), ("indices", pa.list_(pa.int32())), ("values", pa.list_(pa.float64()))])

    def vectors(row, n):
        """The row's vectors, as an Arrow array."""
        x = np.nan_to_num(row["_dense"].flatten().to_numpy(zero_copy_only=False).astype(float).reshape(n, n_dense))
        doc, at = np.nonzero(x)
        s = row["_slot"].to_numpy(zero_copy_only=False).astype(float)
        has = np.flatnonzero(~np.isnan(s))
        docs, ats, vals = [doc, has], [at, s[has].astype(np.int64) + n_dense], [x[doc, at], np.ones(len(has))]
        for v, hits, start in zip(held.value, row["hits"].to_pylist(), starts):
            doc, term, tf = _unpack(hits, n)
            d, place, _, weight = _of_fold(v, fold, doc, term, (1.0 + np.log(tf)) if sublinear else tf.astype(float), n)
            docs.append(d), ats.append(place + start), vals.append(weight)
        d, a, w = (np.concatenate(z) for z in (docs, ats, vals))
        order = np.lexsort((a, d))
        ends = pa.array(np.searchsorted(d[order], np.arange(n + 1)), pa.int32())
        return pa.StructArray.from_arrays(
            [pa.array(np.zeros(n), pa.int8()), pa.array(np.full(n, starts[-1]), pa.int32()),
             pa.ListArray.from_arrays(ends, pa.array(a[order], pa.int32())), pa.ListArray.from_arrays(ends, pa.array(w[order]))], fields=list(vector))

    def work(it):
        for b in it:
            for k in range(b.num_rows):
                row = {c: b.column(c).slice(k, 1).flatten() for c in b.schema.names}
                n = len(row["_slot"])
                cells = [*[row[c] for c in keep], vectors(row, n)]
                if where:
                    took = set(where[1])
                    at = pa.array([j for j, v in enumerate(row[where[0]].to_pylist()) if v in took], pa.int64())
                    cells = [c.take(at) for c in cells]
                if len(cells[-1]):
                    yield pa.RecordBatch.from_arrays(cells, [*keep, out])

    fields = blocks.select(*[F.col(c)[0].alias(c) for c in keep]).schema.fields
    return blocks.mapInArrow(work, StructType([*fields, StructField(out, VectorUDT())]))


def sparse_features(docs: DataFrame, text: Column, vocabs: Sequence[Vocabulary], dense: Sequence[str], slot: str | None, n_slots: int,
                    keep: Sequence[str], fold: int = 0, sublinear: bool = True, out: str = "features") -> DataFrame:
    """P-9: all feature blocks of a document side by side as one sparse vector.

    In order: the columns ``dense`` (null and NaN are 0), ``n_slots`` indicators with a 1 at column ``slot`` (null: none), and the
    TF-IDF weights of each vocabulary in its fold ``fold``. Each block starts where the one before it ends (``offsets``), and
    no zero is stored. ``keep`` columns stay.
    """
    blocks = count_blocks(docs, text, vocabs, dense, slot, keep)
    return block_features(blocks, vocabs, len(dense), n_slots, keep, fold, None, sublinear, out)


def offsets(vocabs: Sequence[Vocabulary], n_dense: int, n_slots: int, fold: int = 0) -> list[int]:
    """First index of each vocabulary's block, and the size of the whole vector."""
    return (n_dense + n_slots + np.cumsum([0, *[v.size(fold) for v in vocabs]])).tolist()


def weight_bins(docs: DataFrame, text: Column, vocab: Vocabulary, y: str, fold: str, n_folds: int, bins: int = 32, prefix: str = "",
                sublinear: bool = True) -> DataFrame:
    """``(k, feature, bin, y, c)`` of the terms' weights in the train part of every fold: bins ``1..bins`` of equal width over
    (0, 1], weights taken to 6 decimals. Tasks count in an array of terms * bins * classes per fold, classes 0 and 1."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(vocab)
    names = ["k", "feature", "bin", "y", "c"]

    def work(it):
        v = held.value
        wanted, n_terms = pa.array(v.terms, pa.string()), len(v.terms)
        total = np.zeros((n_folds, n_terms * bins * 2), np.int64)
        for whole in it:
            for part in _slices(whole, ["_terms"]):
                for b, c in _halving(part, lambda b: (b, v.analyzer.codes(b.column("_terms")))):
                    n = b.num_rows
                    hits = _weights(c, v, wanted, n, sublinear)
                    label, own = (b.column(x).to_numpy(zero_copy_only=False).astype(np.int64) for x in ("_y", "_own"))
                    for k in range(n_folds):
                        doc, _, term, w = _of_fold(v, k, *hits, n)
                        keep = own[doc] != k
                        at = np.minimum((np.round(w[keep], 6) * bins).astype(np.int64), bins - 1)
                        total[k] += np.bincount((term[keep] * bins + at) * 2 + label[doc[keep]], minlength=total.shape[1])
        k, cell = np.nonzero(total)
        term, rest = np.divmod(cell, bins * 2)
        yield pa.RecordBatch.from_arrays([pa.array(k, pa.int32()), pa.array([prefix + v.terms[t] for t in term.tolist()], pa.string()),
                                          pa.array(rest // 2 + 1), pa.array(rest % 2), pa.array(total[k, cell])], names)

    t = vocab.analyzer.prepared(docs, text, "_terms").select(F.col(y).cast("long").alias("_y"), F.col(fold).cast("long").alias("_own"), "_terms")
    return t.mapInArrow(work, "k int, feature string, bin long, y long, c long").groupBy("k", "feature", "bin", "y").agg(F.sum("c").alias("c"))


# ---------------------------------------------------------------- blocks of counts

def _pack(doc, term, tf, n: int) -> bytes:
    """The counts ``(doc, term, tf)`` of ``n`` documents, by document."""
    import pyarrow as pa

    raw = np.concatenate([np.searchsorted(doc, np.arange(n + 1)), term, tf.astype(np.int64)]).astype("<u4").tobytes()
    return np.uint64(len(raw)).tobytes() + pa.compress(raw, codec="zstd", asbytes=True)


def _unpack_counts(packed: bytes, n: int):
    """``(ends, term, tf)`` of a pack: the documents' counts lie between their ends."""
    import pyarrow as pa

    raw = pa.decompress(packed[8:], int(np.frombuffer(packed[:8], np.uint64)[0]), codec="zstd", asbytes=True)
    raw = np.frombuffer(raw, "<u4").astype(np.int64)
    return raw[:n + 1], *(raw[n + 1:].reshape(2, -1) if len(raw) > n + 1 else (np.zeros(0, np.int64),) * 2)


def _unpack(packed: bytes, n: int):
    ends, term, tf = _unpack_counts(packed, n)
    return np.repeat(np.arange(n), np.diff(ends)), term, tf


def hit_blocks(docs: DataFrame, text: Column, vocabs: Sequence[Vocabulary], id_col: str, flag: Column) -> DataFrame:
    """``(ids array<long>, flags array<boolean>, hits array<binary>)``: a row per slice of documents, with the packed counts of
    each vocabulary's terms. A few bytes per term of a document, for steps that pass over all of them more than once."""
    import pyarrow as pa

    held = docs.sparkSession.sparkContext.broadcast(list(vocabs))
    names = [f"_terms{j}" for j in range(len(vocabs))]

    def work(it):
        wanted = [pa.array(v.terms, pa.string()) for v in held.value]
        for whole in it:
            for part in _slices(whole, names):
                for b, codes in _halving(part, lambda b: (b, [v.analyzer.codes(b.column(c)) for v, c in zip(held.value, names)])):
                    n = b.num_rows
                    packed = [_pack(*_weights(c, v, w, n, sublinear=False), n) for v, c, w in zip(held.value, codes, wanted)]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([b.column("_id").to_pylist()], pa.list_(pa.int64())), pa.array([b.column("_flag").to_pylist()], pa.list_(pa.bool_())),
                         pa.array([packed], pa.list_(pa.binary()))], ["ids", "flags", "hits"])

    t = docs
    for v, c in zip(vocabs, names):
        t = v.analyzer.prepared(t, text, c)
    t = t.select(F.col(id_col).cast("long").alias("_id"), F.coalesce(flag, F.lit(False)).alias("_flag"), *names)
    return t.mapInArrow(work, "ids array<long>, flags array<boolean>, hits array<binary>")


def dense_rows(packed: bytes, n: int, vocab: Vocabulary, keep: np.ndarray, step: int = 256, sublinear: bool = True) -> Iterator[np.ndarray]:
    """The L2-normalised rows of a block's documents ``keep``, ``step`` at a time, as dense matrices."""
    ends, term, tf = _unpack_counts(packed, n)
    w = (1.0 + np.log(tf) if sublinear else tf) * vocab.idf[term, 0]
    for lo in range(0, len(keep), step):
        part = keep[lo:lo + step]
        size = ends[part + 1] - ends[part]
        at = np.repeat(ends[part] - (np.cumsum(size) - size), size) + np.arange(size.sum())
        x = np.zeros((len(part), len(vocab.terms)))
        x[np.repeat(np.arange(len(part)), size), term[at]] = w[at]
        norm = np.sqrt((x * x).sum(axis=1, keepdims=True))
        yield x / np.where(norm > 0, norm, 1.0)
