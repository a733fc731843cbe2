"""Retrieval: tokeniser, BM25 over postings, exact dense search, rank fusion, routing.

The tokeniser returns a set, so term frequency is 1 and a document's length is its number of
distinct tokens.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from ..session import ship
from ..sinks import spool
from . import nearest

# Identifiers kept whole, in this order; English stop-words; routes by keyword.
IDENTIFIERS = [
    r"\bcve-\d{4}-\d{4,7}\b", r"\bt\d{4}(?:\.\d{3})?\b", r"\bd3-[a-zA-Z0-9_-]+\b", r"\b\d{1,3}\.\d{1,3}\.\d{1,3}\.\d{1,3}\b", r"\b[a-f0-9]{32}\b", r"\b[a-f0-9]{64}\b",
    r"\b[a-zA-Z0-9._-]+\.[a-zA-Z]{2,6}\b", r"\binc-[\w-]+\b", r"\bpb-\d+\b", r"\bpol-\d+\b",
]
STOP_WORDS = [
    "a", "about", "above", "after", "again", "against", "all", "am", "an", "and", "any", "are", "aren't", "as", "at", "be", "because", "been",
    "before", "being", "below", "between", "both", "but", "by", "can't", "cannot", "could", "couldn't", "did", "didn't", "do", "does", "doesn't",
    "doing", "don't", "down", "during", "each", "few", "for", "from", "further", "had", "hadn't", "has", "hasn't", "have", "haven't", "having", "he",
    "he'd", "he'll", "he's", "her", "here", "here's", "hers", "herself", "him", "himself", "his", "how", "how's", "i", "i'd", "i'll", "i'm", "i've",
    "if", "in", "into", "is", "isn't", "it", "it's", "its", "itself", "let's", "me", "more", "most", "mustn't", "my", "myself", "no", "nor", "not",
    "of", "off", "on", "once", "only", "or", "other", "ought", "our", "ours", "ourselves", "out", "over", "own", "same", "shan't", "she", "she'd",
    "she'll", "she's", "should", "shouldn't", "so", "some", "such", "than", "that", "that's", "the", "their", "theirs", "them", "themselves", "then",
    "there", "there's", "these", "they", "they'd", "they'll", "they're", "they've", "this", "those", "through", "to", "too", "under", "until", "up",
    "very", "was", "wasn't", "we", "we'd", "we'll", "we're", "we've", "were", "weren't", "what", "what's", "when", "when's", "where", "where's",
    "which", "while", "who", "who's", "whom", "why", "why's", "with", "won't", "would", "wouldn't", "you", "you'd", "you'll", "you're", "you've",
    "your", "yours", "yourself", "yourselves",
]
ROUTES = [
    (["cve", "vulnerability", "exploit"], ["cve", "kev"]), (["mitigat", "defend", "prevent", "d3fend"], ["d3fend"]), (["yara", "signature"], ["yara"]), (["sigma", "log", "detect"], ["sigma"]),
    (["playbook", "remediat", "containment"], ["playbook"]), (["policy", "corporate", "compliance"], ["policy"]), (["report", "intel", "actor"], ["threat_report"]), (["past", "history", "previous", "incident"], ["historical_incident"]),
]
ATTACK_WORDS = ["technique", "t1", "ssh", "power", "login", "malicious", "attack"]
K1, B = 1.5, 0.75


def _stem(w: Column) -> Column:
    cut = lambda n: F.substring(w, F.lit(1), F.length(w) - n)
    ends = lambda *xs: [w.endswith(x) for x in xs]
    es = w.endswith("es") & ~(ends("aes")[0] | ends("ees")[0] | ends("oes")[0])
    s = w.endswith("s") & ~(w.endswith("ss") | w.endswith("us") | w.endswith("is"))
    return F.when(F.length(w) <= 4, w).when(w.endswith("ing"), cut(3)).when(w.endswith("edly"), cut(4)).when(w.endswith("ed"), cut(2)).when(es, cut(2)).when(s, cut(1)).otherwise(w)


#: What every text that holds an identifier has somewhere.
_HINT = r"cve-|d3-|inc-|pb-|pol-|t\d{4}|\d\.\d|[a-f0-9]{32}|[a-z0-9._-]\.[a-z]{2}"
#: Bytes (as planned) up to which a corpus is dealt over all cores before it is tokenised.
SMALL = 256 << 20


def _stems(text: Column) -> Column:
    """Stems of a lower-case text's distinct words without stop-words."""
    return F.transform(F.filter(F.array_distinct(F.split(text, "[^a-z0-9]+")), lambda w: (w != "") & ~w.isin(STOP_WORDS)), _stem)


def tokens(text: Column) -> Column:
    """Distinct tokens: identifiers whole, then stemmed words without stop-words; null gives none.

    One search tells texts that can hold no identifier at all; only the others are searched for each
    kind of them.
    """
    low = F.lower(F.coalesce(text, F.lit("")))
    rest, kept = low, []
    for pattern in IDENTIFIERS:
        kept.append(F.regexp_extract_all(rest, F.lit(pattern), F.lit(0)))
        rest = F.regexp_replace(rest, pattern, " ")
    return F.array_distinct(F.when(low.rlike(_HINT), F.concat(*kept, _stems(rest))).otherwise(_stems(low)))


def spread(df: DataFrame) -> DataFrame:
    """A small table (by its plan's estimate) dealt over all cores: a file of one row group is one task."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(df.sparkSession.sparkContext.defaultParallelism) if size <= SMALL else df


def index(docs: DataFrame, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """Postings (id, term, length) and lengths (id, length) of a corpus, written to the shared folder.

    Texts are tokenised once; documents without a token have a length and no posting. Both tables
    can be kept by `sinks.write_index` and changed by `update_index`.
    """
    made = spool(spread(docs.select(F.col(id), F.col(text).alias("_text"))).select(id, tokens(F.col("_text")).alias("_t")))
    return made.select(id, F.explode("_t").alias("term"), F.size("_t").alias("length")), made.select(id, F.size("_t").alias("length"))


def update_index(postings: DataFrame, lengths: DataFrame, changed: DataFrame, gone: DataFrame | None, id: str, text: str) -> tuple[DataFrame, DataFrame]:
    """An index with the documents of `changed` (id, text) added or replaced and those of `gone` (id)
    removed; only changed documents are tokenised."""
    new_postings, new_lengths = index(changed, id, text)
    out = changed.select(id) if gone is None else changed.select(id).union(gone.select(id))
    kept = [df.join(out.distinct(), id, "left_anti") for df in (postings, lengths)]
    added = [new_postings, new_lengths]
    if gone is not None:  # a document that is both changed and gone is gone
        added = [df.join(gone.select(id).distinct(), id, "left_anti") for df in added]
    return kept[0].unionByName(added[0]), kept[1].unionByName(added[1])


#: Query terms that are broadcast at most; more are joined by a shuffle.
TERMS = 1_000_000


#: Postings, times k, that a query's rarest terms are taken up to for its first threshold; what scores may differ by;
#: terms a query (in the mean) beyond which bounds add up to so much that hardly any term is weak.
LEAD, NEAR, LONG = 20, 1e-6, 12


def _impact(length: Column, mean: Column) -> Column:
    """What a posting counts, before its term's weight."""
    return (K1 + 1) / (1 + K1 * (1 - B + B * length / mean))


def bm25(queries: DataFrame, postings: DataFrame, lengths: DataFrame, query_id: str, id: str, k: int, only: DataFrame | None = None) -> DataFrame:
    """The k best documents of each query (query_id, term): rank, score, ties by id.

    Of the postings only those are scored that can matter. Each term has a bound, the impact of its
    shortest document. The documents of a query's rarest terms give a first threshold: the k-th best of
    their scores so far. Terms whose bounds together stay under it can't bring in a document by themselves; so
    candidates come from the other terms, those that can't reach the threshold are dropped, and the weak
    terms are looked up for the rest only. Queries are written once, their (counted) side is broadcast.
    `only` (id): the documents that may be hits, which does not change the frequencies.
    """
    few = postings if "length" in postings.columns else postings.join(lengths, id)
    asked = spool(queries.select(query_id, "term").distinct())
    pairs, many = asked.agg(F.count("*"), F.count_distinct(query_id)).first()
    terms = _weighed_terms(asked, pairs, few, lengths)
    allowed = few if only is None else few.join(only.select(id).distinct(), id, "left_semi")
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc(F.round("score", 9)), id))
    if pairs > LONG * many and pairs <= TERMS:
        scores = _scanned(allowed, terms, query_id, id, k)
        return scores.withColumn("rank", place).filter(F.col("rank") <= k)
    if pairs > LONG * many:
        plain = terms.withColumns({"weak": F.lit(0.0), "least": F.lit(None).cast("double")})
        scores = _hits(allowed, plain, query_id, id).groupBy(query_id, id).agg(F.sum("part").alias("score"))
        return scores.withColumn("rank", place).filter(F.col("rank") <= k)
    marked, few = _marked_terms(terms, allowed, query_id, id, k), allowed
    strong = _hits(few, marked.filter("strong"), query_id, id).groupBy(query_id, id).agg(F.sum("part").alias("score"), F.first("weak").alias("weak"), F.first("least").alias("least"))
    strong = spool(strong.filter(F.col("least").isNull() | (F.col("score") + F.col("weak") >= F.col("least") - NEAR)).select(query_id, id, "score"))
    # A candidate's weak terms are asked for by document and term, so no other document's postings meet a query.
    asked = strong.select(query_id, id).join(marked.filter("not strong"), query_id)
    small = F.broadcast if asked.count() <= TERMS else lambda df: df
    weak = _scored(few.join(small(asked), [id, "term"]), query_id, id)
    scores = strong.unionByName(weak.select(query_id, id, F.col("part").alias("score"))).groupBy(query_id, id).agg(F.sum("score").alias("score"))
    return scores.withColumn("rank", place).filter(F.col("rank") <= k)


class Scan:
    """The k best documents of each slot (a query, or a query and a source) by BM25 so far, of postings offered by document.

    Terms are numbers: those of term t are `starts[t]` to `starts[t + 1]` of `slots` and `idf`, and its source's mean length is `mean[t]`.
    """

    def __init__(self, starts: np.ndarray, slots: np.ndarray, idf: np.ndarray, mean: np.ndarray, count: int, k: int):
        self.starts, self.slots, self.idf, self.mean, self.count, self.k = starts, slots, idf, mean, count, k
        self.bound, self.held = np.full(count, -np.inf), None

    def _best(self, q: np.ndarray, ids: pa.Array, score: np.ndarray) -> tuple[np.ndarray, pa.Array, np.ndarray]:
        """The k best of each slot, in the order of rounded scores and ids."""
        turn = np.empty(len(ids), np.int64)
        turn[pc.sort_indices(ids).to_numpy()] = np.arange(len(ids))
        order = np.lexsort((turn, -np.round(score, 9), q))
        fresh = np.append(True, q[order][1:] != q[order][:-1])
        rank = np.arange(len(order)) - np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
        last = order[rank == self.k - 1]
        self.bound[q[last]] = np.round(score[last], 9)
        order = order[rank < self.k]
        return q[order], ids.take(pa.array(order)), score[order]

    def offer(self, ids: pa.Array, doc: np.ndarray, t: np.ndarray, length: np.ndarray) -> None:
        """Postings of whole documents (places in `ids`, a document's next to each other), so many at once that
        their products stay bounded."""
        if not len(t):
            return
        starts, many = self.starts, self.starts[t + 1] - self.starts[t]
        begin = np.flatnonzero(np.append(True, doc[1:] != doc[:-1]))
        block = np.cumsum(many)[np.append(begin[1:], len(t)) - 1] // nearest.PRODUCTS
        for cut in np.split(np.arange(len(begin)), np.flatnonzero(np.diff(block)) + 1):
            low, high = begin[cut[0]], begin[cut[-1] + 1] if cut[-1] + 1 < len(begin) else len(t)
            n = many[low:high]
            place = np.repeat(starts[t[low:high]] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            part = self.idf[place] * np.repeat((K1 + 1) / (1 + K1 * (1 - B + B * length[low:high] / self.mean[t[low:high]])), n)
            pair, of = np.unique(np.repeat(doc[low:high].astype(np.int64), n) * self.count + self.slots[place], return_inverse=True)
            score, q = np.bincount(of, part), pair % self.count
            some = np.round(score, 9) >= self.bound[q]
            found, held = (q[some], ids.take(pa.array(pair[some] // self.count)), score[some]), self.held
            self.held = self._best(*(found if held is None else (np.append(held[0], found[0]), pa.concat_arrays([held[1], found[1]]), np.append(held[2], found[2]))))


def _scanned(postings: DataFrame, terms: DataFrame, query_id: str, id: str, k: int) -> DataFrame:
    """Scores of long queries, document by document: rows query_id, id, score, the k best of each query in each task.

    The terms (at most `TERMS`) are broadcast, postings of these terms meet by document, and a task holds the products of
    some documents and the k best of each query so far, so a pair of query and document is never a row of a shuffle.
    """
    ship(postings.sparkSession)
    asked = terms.select(query_id, "term", "idf", "mean").toArrow().combine_chunks()
    words, names = (asked[c].combine_chunks().dictionary_encode() if len(asked) else pa.array([], asked.schema.field(c).type).dictionary_encode() for c in ("term", query_id))
    at, queries = words.indices.to_numpy(), names.indices.to_numpy()
    order = np.argsort(at, kind="stable")
    starts = np.searchsorted(at[order], np.arange(len(words.dictionary) + 1))
    mean = np.full(len(words.dictionary), float(asked["mean"][0].as_py()) if len(asked) else 1.0)
    shared = postings.sparkSession.sparkContext.broadcast((names.dictionary, (starts, queries[order], asked["idf"].to_numpy()[order], mean, len(names.dictionary), k)))
    numbers = postings.sparkSession.createDataFrame(pa.table({"term": words.dictionary, "_t": pa.array(np.arange(len(words.dictionary)))}), "term string, _t long")
    met = postings.join(F.broadcast(numbers), "term").select(id, "_t", F.col("length").cast("double").alias("length"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, told = shared.value
        scan = Scan(*told)

        def scored(rows: pa.Table) -> None:
            ids = rows[id].combine_chunks().dictionary_encode() if rows[id].num_chunks != 1 else rows[id].chunk(0).dictionary_encode()
            scan.offer(ids.dictionary, ids.indices.to_numpy(), rows["_t"].to_numpy(), rows["length"].to_numpy())

        rest = None  # the last document's rows, as the next batch may have more of them
        for batch in batches:
            if len(batch):
                rows = pa.Table.from_batches([batch]) if rest is None else pa.concat_tables([rest, pa.Table.from_batches([batch])]).combine_chunks()
                first = pc.index(rows[id], rows[id][-1]).as_py()
                rest = rows.slice(first)
                if first:
                    scored(rows.slice(0, first))
        if rest is not None:
            scored(rest)
        if scan.held is not None:
            q, ids, score = scan.held
            yield pa.RecordBatch.from_arrays([names.take(pa.array(q)), ids, pa.array(score)], [query_id, id, "score"])

    kinds = StructType([terms.schema[query_id], postings.schema[id], StructField("score", DoubleType())])
    return met.repartition(id).sortWithinPartitions(id).mapInArrow(run, kinds)


def scanned_by_source(made: DataFrame, terms: DataFrame, query_id: str, id: str, k: int) -> DataFrame:
    """Scores of documents among those of their source: rows query_id, source, id, score, the k best of each query and source
    in each task.

    `made`: source, id (each pair once, without nulls) and the distinct tokens `_t`, a document a row, so nothing of it is
    shuffled. `terms` (at most `TERMS`, broadcast): query_id, source, term, idf and the source's mean length.
    """
    ship(made.sparkSession)
    asked = terms.select(query_id, "source", "term", "idf", "mean").toArrow().combine_chunks()
    code = lambda c: pc.dictionary_encode(pa.concat_arrays(asked[c].chunks) if asked[c].num_chunks else pa.array([], asked.schema.field(c).type), null_encoding="encode")
    names, sources, words = (code(c) for c in (query_id, "source", "term"))
    q, of, word = (x.indices.to_numpy().astype(np.int64) for x in (names, sources, words))
    pairs, slot = np.unique(q * max(len(sources.dictionary), 1) + of, return_inverse=True)
    keys, t = np.unique(of * max(len(words.dictionary), 1) + word, return_inverse=True)
    order = np.argsort(t, kind="stable")
    mean = np.ones(len(keys))
    mean[t] = asked["mean"].to_numpy()
    edges = np.searchsorted(keys, np.arange(len(sources.dictionary) + 1) * max(len(words.dictionary), 1))
    known = {g: (int(a), words.dictionary.take(pa.array(keys[a:b] % len(words.dictionary)))) for g, a, b in zip(sources.dictionary.to_pylist(), edges, edges[1:])}
    labels = [x.dictionary.take(pa.array(i)) for x, i in ((names, pairs // max(len(sources.dictionary), 1)), (sources, pairs % max(len(sources.dictionary), 1)))]
    told = (np.searchsorted(t[order], np.arange(len(keys) + 1)), slot[order], asked["idf"].to_numpy()[order], mean, len(pairs), k)
    shared = made.sparkSession.sparkContext.broadcast((labels, known, told))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        labels, known, told = shared.value
        scan = Scan(*told)
        for batch in batches:
            for g in pc.unique(batch.column(0)).to_pylist() if len(batch) else []:
                if g in known:
                    first, words = known[g]
                    rows = batch.filter(pc.equal(batch.column(0), g))
                    tokens, length = rows.column(2), pc.list_value_length(rows.column(2)).to_numpy().astype(np.float64)
                    at = pc.index_in(tokens.flatten(), value_set=words)
                    there, doc = pc.is_valid(at), pc.list_parent_indices(tokens)
                    doc = doc.filter(there).to_numpy()
                    scan.offer(rows.column(1), doc, at.filter(there).to_numpy().astype(np.int64) + first, length[doc])
        if scan.held is not None:
            q, ids, score = scan.held
            yield pa.RecordBatch.from_arrays([*(x.take(pa.array(q)) for x in labels), ids, pa.array(score)], [query_id, "source", id, "score"])

    kinds = StructType([terms.schema[query_id], terms.schema["source"], made.schema[id], StructField("score", DoubleType())])
    return made.select("source", id, "_t").mapInArrow(run, kinds)


def _hits(postings: DataFrame, terms: DataFrame, query_id: str, id: str) -> DataFrame:
    """A row for each query, document and term of both: part, what it adds to the score, and the query's facts."""
    small = F.broadcast if terms.count() <= TERMS else lambda df: df
    return _scored(postings.join(small(terms), "term"), query_id, id)


def _scored(hits: DataFrame, query_id: str, id: str) -> DataFrame:
    return hits.select(query_id, id, (F.col("idf") * _impact(F.col("length"), F.col("mean"))).alias("part"), "weak", "least")


def _weighed_terms(asked: DataFrame, pairs: int, few: DataFrame, lengths: DataFrame) -> DataFrame:
    """Each query's terms that any document has, written: df, idf, mean length, bound (what a document gets for it at most)."""
    small = F.broadcast if pairs <= TERMS else lambda df: df
    size = lengths.agg(F.count("*").alias("n"), F.avg("length").alias("mean"))  # one row
    stats = few.join(small(asked.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("df"), F.min("length").alias("shortest"))
    idf = F.log((F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5) + 1)
    terms = asked.join(stats, "term").join(F.broadcast(size)).withColumn("idf", idf).withColumn("bound", F.col("idf") * _impact(F.col("shortest"), F.col("mean")))
    return spool(terms.select(*asked.columns, "df", "mean", "idf", "bound"))


def _marked_terms(terms: DataFrame, few: DataFrame, query_id: str, id: str, k: int) -> DataFrame:
    """`_weighed_terms`, written, with strong (whether a term can bring in documents), weak (what all others can
    add at most) and least (the score that k documents are known to reach, null if unknown)."""
    by_df = Window.partitionBy(query_id).orderBy("df", "term").rowsBetween(Window.unboundedPreceding, -1)
    by_bound = Window.partitionBy(query_id).orderBy("bound", "term").rowsBetween(Window.unboundedPreceding, 0)
    terms = terms.withColumns({"before": F.coalesce(F.sum("df").over(by_df), F.lit(0)), "upto": F.sum("bound").over(by_bound), "weak": F.lit(0.0), "least": F.lit(None).cast("double")})
    first = _hits(few, terms.filter(F.col("before") < LEAD * k), query_id, id).groupBy(query_id, id).agg(F.sum("part").alias("score"))
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("score"), id))
    least = first.withColumn("p", place).filter(F.col("p") == k).select(query_id, F.col("score").alias("least"))
    known = terms.drop("weak", "least").join(least, query_id, "left").withColumn("strong", F.col("least").isNull() | (F.col("upto") >= F.col("least") - NEAR))
    weak = F.sum(F.when(~F.col("strong"), F.col("bound")).otherwise(0.0)).over(Window.partitionBy(query_id))
    return spool(known.withColumn("weak", weak).select(query_id, "term", "mean", "idf", "strong", "weak", "least"))


def dense(queries: DataFrame, vectors: DataFrame, query_id: str, id: str, vector: str, k: int, most: int = nearest.MOST) -> DataFrame:
    """The k nearest vectors of each query (query_id, q), exactly: rank and squared distance."""
    return nearest.nearest(queries, vectors, query_id, id, vector, k, most)


def fuse(dense_hits: DataFrame, lexical_hits: DataFrame, keys: list[str], weights: dict[str, float] | None = None, k: int = 60, dense_weight: float = 1.0, lexical_weight: float = 0.8) -> DataFrame:
    """Reciprocal rank fusion of hits with rank (and distance, score): rrf and how each was found.

    Hits may carry the document's confidence, which weighs their part; without one it is 1.
    """
    sure = lambda df: F.coalesce(F.col("confidence"), F.lit(1.0)) if "confidence" in df.columns else F.lit(1.0)
    d = dense_hits.select(*keys, F.col("rank").alias("dense_rank"), "distance", sure(dense_hits).alias("_dense_sure"))
    x = lexical_hits.select(*keys, F.col("rank").alias("lexical_rank"), "score", sure(lexical_hits).alias("_lexical_sure"))
    both = d.join(x, keys, "full")
    part = lambda kind, w: F.when(F.col(f"{kind}_rank").isNull(), 0.0).otherwise(w * F.col(f"_{kind}_sure") / (k + F.col(f"{kind}_rank")))
    scale = F.lit(1.0)
    for source, w in (weights or {}).items():
        scale = F.when(F.col("source") == source, w).otherwise(scale)
    method = F.when(F.col("dense_rank").isNotNull() & F.col("lexical_rank").isNotNull(), "hybrid").when(F.col("dense_rank").isNotNull(), "dense").otherwise("lexical")
    return both.withColumns({"rrf": (part("dense", dense_weight) + part("lexical", lexical_weight)) * scale, "method": method}).drop("_dense_sure", "_lexical_sure")


def order_fused(fused: DataFrame, query_id: str, id: str, limit: int) -> DataFrame:
    """The best fused hits of each query: by rrf, then nearness, BM25 and id, all descending."""
    place = F.row_number().over(Window.partitionBy(query_id).orderBy(F.desc("rrf"), F.desc(-F.coalesce("distance", F.lit(999.0))), F.desc(F.coalesce("score", F.lit(0.0))), F.desc(id)))
    return fused.withColumn("place", place).filter(F.col("place") <= limit)


def route(text: Column) -> Column:
    """The providers that a query goes to, each once, in a fixed order."""
    low = F.lower(F.coalesce(text, F.lit("")))
    found = F.array_compact(F.flatten(F.array(*[F.array(*[F.when(_any(low, words), p) for p in providers]) for words, providers in ROUTES])))
    attack = (F.size(found) == 0) | _any(low, ATTACK_WORDS)
    return F.when(attack, F.array_append(found, F.lit("attack"))).otherwise(found)


def _any(text: Column, words: list[str]) -> Column:
    out = F.lit(False)
    for w in words:
        out = out | text.contains(w)
    return out


def matches(df: DataFrame, filters: dict[str, object]) -> Column:
    """Whether a row of `df` meets filters: a column's value, or any element of a list column (by the
    schema), is the wanted value or one of the wanted ones. Nulls meet nothing."""
    kinds, out = dict(df.dtypes), F.lit(True)
    for name, wanted in filters.items():
        values = list(wanted) if isinstance(wanted, (list, tuple)) else [wanted]
        column = F.col(name)
        out = out & (F.arrays_overlap(column, F.array(*map(F.lit, values))) if kinds[name].startswith("array") else column.isin(values))
    return F.coalesce(out, F.lit(False))


def merge_lists(a: Column, b: Column) -> Column:
    """Tags or references of the same document from two hits, each once; null counts as none."""
    none = F.array().cast("array<string>")
    return F.array_union(F.coalesce(a, none), F.coalesce(b, none))


def rerank(hits: DataFrame, query_id: str, score: str) -> DataFrame:
    """A reranker's scores (null without a model: then the fused score) normalised to 0..1."""
    own = Window.partitionBy(query_id)
    s = F.coalesce(F.col(score), F.col("rrf"))
    low, high = F.min(s).over(own), F.max(s).over(own)
    return hits.withColumn("rerank", F.when(high > low, (s - low) / (high - low)).otherwise(1.0))


def upsert(docs: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Documents with changed ones replaced and new ones added."""
    return docs.join(changes.select(keys), keys, "left_anti").select(docs.columns).unionByName(changes.select(docs.columns))


def remove(docs: DataFrame, gone: DataFrame, keys: list[str]) -> DataFrame:
    """Documents without those named."""
    return docs.join(gone.select(keys).distinct(), keys, "left_anti").select(docs.columns)


def dedup_hits(hits: DataFrame, keys: list[str], distance: str) -> DataFrame:
    """Each document's nearest hit; of equally near ones the first by all columns."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(distance, F.to_json(F.struct(*sorted(hits.columns)))))
    return hits.withColumn("_p", place).filter("_p = 1").drop("_p")


def attack_lookup(hits: DataFrame, nodes: DataFrame, technique: str) -> DataFrame:
    """Hits with the knowledge-graph node of their technique id, whatever its case; null without one.

    The side of nodes is joined by size: Spark broadcasts it only where it is small.
    """
    known = nodes.select(F.upper("external_id").alias("_x"), F.col("node_id").alias("stix_id"), F.col("name").alias("stix_name"))
    return hits.join(known, F.upper(F.col(technique)) == F.col("_x"), "left").drop("_x")
