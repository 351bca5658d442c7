"""Retrieval: the keyword arm (BM25 over postings), the vector arm (cosine), and results as of a past day.

Each arm returns its own scores; nothing is fused. Postings are a table (doc_id, token_id, weight) to be written once and
joined per query; a query is a handful of literal rows, whose size is known, and the only thing broadcast.

Tables of queries go in blocks of bounded size, each broadcast in turn: rows stream past a block, every task keeps the best
of each of its queries, and only those are shuffled, so hot tokens and many queries make work but no skew.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache, reduce
from hashlib import md5

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from lexstrata.functions import lexical
from lexstrata.functions.temporal import in_force
from lexstrata.functions.text import first_line
from lexstrata.operators.ledger import KEY
from lexstrata.session import cut_lineage, spread

ARMS = ("dense", "bm25")
LEDGER = [*KEY, "valid_from", "valid_to", "is_current"]  # what a search needs of a ledger's rows beside id and loaded_at
RECALL = 3
API_LIMIT = 20
BLOCK_QUERIES = 2_000
BLOCK_VALUES = 1_000_000  # tokens or vector components of a block's queries
PART_ROWS = 256
POSTING_BUCKETS = 64


def token_number(token: str) -> int:
    """lexical.token_id outside of SQL."""
    return int.from_bytes(md5(token.encode()).digest()[:4], "little")


class _Postings:
    """Arrow batches (doc_id, text) to postings; wanted: the only tokens that leave, None for all."""

    def __init__(self, wanted: frozenset[str] | None):
        self.wanted = wanted

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = lru_cache(1 << 18)(token_number)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, tfs, lengths, firsts, rows = [], [], [], [], []
                for row, text in enumerate(part.column(1).to_pylist()):
                    counts, length = lexical.token_counts(text)
                    seen: set[int] = set()
                    for token in counts if self.wanted is None else self.wanted & counts.keys():
                        i = number(token)
                        ids.append(i)
                        tfs.append(counts[token])
                        lengths.append(length)
                        firsts.append(i not in seen)
                        rows.append(row)
                        seen.add(i)
                doc = part.column(0).take(pa.array(rows, pa.int64()))
                yield pa.RecordBatch.from_arrays([doc, pa.array(ids, pa.int64()), pa.array(tfs, pa.int64()), pa.array(lengths, pa.int64()), pa.array(firsts, pa.bool_())], ["doc_id", "token_id", "tf", "length", "first"])


def postings(docs: DataFrame, doc_id: str, text: str, wanted: list[str] | None = None) -> DataFrame:
    """(doc_id, token_id, tf, length, first, weight) of every distinct token of every document; ids are assumed distinct.

    Counted within each row, so nothing is shuffled. first: whether it's the document's first token of this id (ids may collide).
    """
    rows = spread(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("string").alias("text")))
    schema = T.StructType([rows.schema["doc_id"], T.StructField("token_id", T.LongType()), T.StructField("tf", T.LongType()), T.StructField("length", T.LongType()), T.StructField("first", T.BooleanType())])
    out = rows.mapInArrow(_Postings(None if wanted is None else frozenset(wanted)), schema)
    return out.withColumn("weight", lexical.tf_weight(F.col("tf"), F.col("length")))


def document_frequencies(posted: DataFrame) -> DataFrame:
    """(token_id, df): documents a token id; combined map-side."""
    return posted.groupBy("token_id").agg(F.count_if("first").alias("df"))


class _Numbers:
    """Arrow batches (text) to (token_id, df), counted within the task, handing on at BLOCK_VALUES ids."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, seen = lru_cache(1 << 18)(token_number), Counter()
        for batch in batches:
            for text in batch.column(0).to_pylist():
                seen.update(set(map(number, lexical.token_counts(text)[0])))
                if len(seen) > BLOCK_VALUES:
                    yield self._out(seen)
                    seen = Counter()
        yield self._out(seen)

    def _out(self, seen: Counter[int]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(seen.keys(), pa.int64()), pa.array(seen.values(), pa.int64())], ["token_id", "df"])


def token_frequencies(docs: DataFrame, text: str) -> DataFrame:
    """document_frequencies straight from the texts: no posting leaves a task, only its tokens' counts."""
    return spread(docs.select(F.col(text).cast("string").alias("text"))).mapInArrow(_Numbers(), "token_id long, df long").groupBy("token_id").agg(F.sum("df").alias("df"))


def write_postings(posted: DataFrame, root: str, buckets: int = POSTING_BUCKETS) -> None:
    """Postings as a stored table, one folder a bucket of token ids, to be searched by bm25_stored."""
    bucketed = posted.withColumn("bucket", (F.col("token_id") % buckets).cast("int"))
    # A token of every document must not be one task's: rows go by token and document.
    bucketed.repartition(F.col("bucket"), F.pmod(F.xxhash64("doc_id"), F.lit(8))).write.partitionBy("bucket").parquet(root)


def bm25_stored(spark: SparkSession, root: str, n_docs: DataFrame, query: str, limit: int, buckets: int = POSTING_BUCKETS) -> DataFrame:
    """(doc_id, score) over stored postings: only the folders of the query's tokens are read."""
    wanted = sorted({token_number(t) % buckets for t in lexical.query_terms(query)})
    return bm25_search(spark.read.parquet(root).where(F.col("bucket").isin(wanted)), n_docs, query, limit)


def query_tokens(docs: DataFrame, query: str) -> DataFrame:
    """The distinct token ids of a query, each of weight 1."""
    terms = F.array(*[F.lit(t) for t in lexical.query_terms(query)]).cast("array<string>")
    return docs.sparkSession.range(1).select(F.explode(terms).alias("token")).select(lexical.token_id(F.col("token")).alias("token_id")).distinct()


def bm25_search(posted: DataFrame, n_docs: DataFrame, query: str, limit: int) -> DataFrame:
    """(doc_id, score): the best documents that hold any of the query's tokens; ties by id. posted: all postings; n_docs: one row, one column."""
    return _scored(posted.join(F.broadcast(query_tokens(posted, query)), "token_id"), n_docs, limit)


def bm25_scan(docs: DataFrame, doc_id: str, text: str, query: str, limit: int) -> DataFrame:
    """The keyword arm without a postings table: only the query's tokens ever leave a document's row."""
    return _scored(postings(docs, doc_id, text, lexical.query_terms(query)), docs.agg(F.count(F.lit(1))), limit)


def _scored(hits: DataFrame, n_docs: DataFrame, limit: int) -> DataFrame:
    """Hits are written once, for the tokens' frequencies (a short list, joined back) and for the sums."""
    hits = cut_lineage(hits.select("doc_id", "token_id", "first", "weight"))
    df = document_frequencies(hits)
    scored = hits.join(F.broadcast(df), "token_id").groupBy("doc_id").agg(F.sum(F.col("weight") * lexical.idf(n_docs.scalar(), F.col("df"))).alias("score"))
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)


def cosine(a: Column, b: Column) -> Column:
    """In double precision; null for a zero vector."""
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)
    size = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(size > 0, dot(a, b) / size)


def dense_search(vectors: DataFrame, vec_id: str, embedding: str, query: list[float], limit: int) -> DataFrame:
    """(doc_id, score): exact cosine top-k; only ids and scores are sorted. Null and zero vectors, and all if the query is empty, have no score and no place."""
    q = F.array(*[F.lit(float(x)) for x in query]).cast("array<double>")
    scored = vectors.select(F.col(vec_id).alias("doc_id"), cosine(F.col(embedding), q).alias("score")).where(F.col("score").isNotNull())
    return scored.orderBy(F.desc("score"), "doc_id").limit(limit)


class _Best:
    """The best `limit` rows of each query of a block, by score to nine digits, then id; -inf is no hit."""

    def __init__(self, queries: np.ndarray, limit: int):
        self.queries, self.limit = queries, limit
        self.least = np.full(len(queries), -np.inf)
        self.at, self.doc, self.score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)

    def add(self, docs: np.ndarray, scores: np.ndarray) -> None:
        """scores: a row a document, a column a query."""
        place = np.round(scores, 9)
        if len(docs) >= self.limit:
            self.least = np.maximum(self.least, np.partition(place, -self.limit, axis=0)[-self.limit])
        row, at = np.nonzero((place >= self.least) & (place > -np.inf))
        at, doc, score = np.r_[self.at, at], np.r_[self.doc, docs[row]], np.r_[self.score, scores[row, at]]
        order = np.lexsort((doc, -np.round(score, 9), at))
        at, doc, score = at[order], doc[order], score[order]
        rank = np.arange(len(at)) - np.searchsorted(at, at)
        kept = rank < self.limit
        full = rank == self.limit - 1
        self.least[at[full]] = np.round(score[full], 9)
        self.at, self.doc, self.score = at[kept], doc[kept], score[kept]

    def batch(self) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(self.queries[self.at]), pa.array(self.doc), pa.array(self.score)], ["query_id", "doc_id", "score"])


BEST_SCHEMA = "query_id long, doc_id long, score double"


def _unit(column: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(rows, their vectors in double precision, of unit length) of those that have `size` components, none null, not all zero."""
    flat = column.flatten()
    lengths = np.array(column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False))
    holes = np.r_[0, np.cumsum(flat.is_null().to_numpy(zero_copy_only=False))]
    ends = np.cumsum(np.maximum(lengths, 0))
    rows = np.flatnonzero((lengths == size) & (holes[ends] == holes[ends - np.maximum(lengths, 0)]))
    values = flat.to_numpy(zero_copy_only=False).astype(np.float64)
    made = values[(ends[rows] - size)[:, None] + np.arange(size)]
    norm = np.sqrt((made * made).sum(axis=1))
    some = norm > 0
    return rows[some], made[some] / norm[some, None]


class _DenseBlock:
    """Arrow batches (doc_id, embedding) against a broadcast block of queries, {size: (ids, unit vectors)}, to the best of each."""

    def __init__(self, block, limit: int):
        self.block, self.limit = block, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = {size: _Best(ids, self.limit) for size, (ids, _) in self.block.value.items()}
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                for size, (_, asked) in self.block.value.items():
                    rows, vectors = _unit(part.column(1), size)
                    if len(rows):
                        best[size].add(part.column(0).to_numpy()[rows], vectors @ asked.T)
        for b in best.values():
            yield b.batch()


class _KeywordBlock:
    """Arrow batches (doc_id, text) against a broadcast block of queries to the best of each; (ids, number of a token, where a token's queries begin, queries, idf of each token)."""

    def __init__(self, block, limit: int):
        self.block, self.limit = block, limit

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, number, begins, queries, idf = self.block.value
        best = _Best(ids, self.limit)
        # tokens of more than an eighth of the queries, hence at most 8 * BLOCK_VALUES cells, go by matrix product
        often = np.flatnonzero(np.diff(begins) > len(ids) / 8)
        column = np.full(len(idf), -1)
        column[often] = np.arange(len(often))
        held = np.zeros((len(often), len(ids)))
        for k, token in enumerate(often):
            held[k, queries[begins[token] : begins[token + 1]]] = idf[token]
        for batch in batches:
            for start in range(0, batch.num_rows, PART_ROWS):
                part = batch.slice(start, PART_ROWS)
                scores, weights = np.zeros((part.num_rows, len(ids))), np.zeros((part.num_rows, len(often)))
                for row, text in enumerate(part.column(1).to_pylist()):
                    counts, length = lexical.token_counts(text)
                    known = [(number[t], n) for t, n in counts.items() if t in number]
                    if not known:
                        continue
                    token, tf = np.array(known, np.int64).T
                    weight, spot = lexical.tf_weight(tf, length), column[token]
                    weights[row, spot[spot >= 0]] = weight[spot >= 0]
                    token, weight = token[spot < 0], weight[spot < 0] * idf[token[spot < 0]]
                    size = begins[token + 1] - begins[token]
                    spot = np.arange(size.sum()) + np.repeat(begins[token] - np.cumsum(size) + size, size)
                    scores[row] = np.bincount(queries[spot], np.repeat(weight, size), len(ids))
                scores += weights @ held
                scores[scores == 0] = -np.inf  # every token's share is above 0
                best.add(part.column(0).to_numpy(), scores)
        yield best.batch()


class _Frequencies:
    """Arrow batches (doc_id, text) to (token, df), counted within the task, handing on at BLOCK_VALUES tokens."""

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter[str] = Counter()
        for batch in batches:
            for text in batch.column(1).to_pylist():
                seen.update(lexical.token_counts(text)[0].keys())
                if len(seen) > BLOCK_VALUES:
                    yield self._out(seen)
                    seen = Counter()
        if seen:
            yield self._out(seen)

    def _out(self, seen: Counter[str]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(seen), pa.string()), pa.array(list(seen.values()), pa.int64())], ["token", "df"])


def _query_terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(query_id, text) to (query_id, token), distinct."""
    for batch in batches:
        for start in range(0, batch.num_rows, PART_ROWS):
            part = batch.slice(start, PART_ROWS)
            terms = [lexical.query_terms(t) for t in part.column(1).to_pylist()]
            ids = np.repeat(part.column(0).to_numpy(), [len(t) for t in terms])
            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array([x for t in terms for x in t], pa.string())], ["query_id", "token"])


def _blocks(queries: DataFrame, values: Column) -> Iterator[pa.Table]:
    """A table of queries, written once, in blocks of about BLOCK_QUERIES rows and BLOCK_VALUES values at most; one at a time comes to the driver."""
    queries = cut_lineage(queries)
    n, total = queries.agg(F.count(F.lit(1)), F.coalesce(F.sum(values.cast("long")), F.lit(0))).first()
    blocks = max(-(-n // BLOCK_QUERIES), -(-total // BLOCK_VALUES))
    for b in range(blocks):
        block = queries.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == b).toArrow()
        if block.num_rows:
            yield block


def _best_of(parts: list[DataFrame], spark, limit: int) -> DataFrame:
    if not parts:
        return spark.createDataFrame([], BEST_SCHEMA)
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.round("score", 9).desc(), "doc_id"))
    return reduce(DataFrame.unionByName, parts).withColumn("rank", rank).where(F.col("rank") <= limit).drop("rank")


def dense_search_all(vectors: DataFrame, vec_id: str, embedding: str, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score): the exact cosine top-k of every row of queries (query_id, embedding) over all vectors; ties (to nine digits) by id.

    Null and zero vectors and those with null components have no score, nor have pairs of different length; ids are whole numbers, null ids are left out.
    """
    spark = vectors.sparkSession
    rows = vectors.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("doc_id"), F.col(embedding).alias("embedding"))
    asked = queries.where("query_id is not null and embedding is not null").select(F.col("query_id").cast("long").alias("query_id"), "embedding")
    parts = []
    for block in _blocks(asked, F.size("embedding")):
        column, ids = block["embedding"].combine_chunks(), block["query_id"].to_numpy()
        found = {n: _unit(column, n) for n in set(column.value_lengths().to_pylist()) if n}
        sent = spark.sparkContext.broadcast({n: (ids[r], v) for n, (r, v) in found.items() if len(r)})
        parts.append(rows.mapInArrow(_DenseBlock(sent, limit), BEST_SCHEMA))
    return _best_of(parts, spark, limit)


def bm25_search_all(docs: DataFrame, doc_id: str, text: str, queries: DataFrame, limit: int) -> DataFrame:
    """(query_id, doc_id, score): the best documents for every row of queries (query_id, text); ties (to nine digits) by id.

    Tokens are told apart by themselves, not by their ids. Ids are whole numbers, those of documents assumed distinct, null ids left out.
    """
    spark = docs.sparkSession
    rows = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).cast("string").alias("text"))
    asked = queries.where("query_id is not null").select(F.col("query_id").cast("long").alias("query_id"), F.col("text").cast("string").alias("text"))
    df = rows.mapInArrow(_Frequencies(), "token string, df long").groupBy("token").agg(F.sum("df").alias("df"))
    terms = asked.mapInArrow(_query_terms, "query_id long, token string").distinct().join(df, "token")
    terms = terms.select("query_id", "token", lexical.idf(F.lit(rows.count()), F.col("df")).alias("idf"))
    parts = []
    for block in _blocks(terms.groupBy("query_id").agg(F.collect_list("token").alias("tokens"), F.collect_list("idf").alias("idfs")), F.size("tokens")):
        tokens, idfs = block["tokens"].combine_chunks(), block["idfs"].combine_chunks()
        coded = tokens.flatten().dictionary_encode()
        code = coded.indices.to_numpy().astype(np.int64)
        order = np.argsort(code, kind="stable")
        begins = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))]
        query = np.repeat(np.arange(block.num_rows), tokens.value_lengths().to_numpy())
        number = {t: k for k, t in enumerate(coded.dictionary.to_pylist())}
        sent = spark.sparkContext.broadcast((block["query_id"].to_numpy(), number, begins, query[order], idfs.flatten().to_numpy()[order][begins[:-1]]))
        parts.append(rows.mapInArrow(_KeywordBlock(sent, limit), BEST_SCHEMA))
    return _best_of(parts, spark, limit)


def encoder(model: Callable[[], Callable[[list[str]], np.ndarray]], batch: int = 256) -> Callable:
    """A column function text -> ARRAY<FLOAT> from a model loader: loaded once a Python worker, called with batches of texts."""

    @F.pandas_udf(T.ArrayType(T.FloatType()))
    def encode(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = model()
        for texts in parts:
            given = texts.fillna("").tolist()
            out = [v for i in range(0, len(given), batch) for v in run(given[i : i + batch])]
            yield pd.Series(out, index=texts.index)

    return encode


def hashed_model(size: int = 64) -> Callable[[list[str]], np.ndarray]:
    """A stand-in for a trained encoder: signed counts of hashed tokens, of unit length (all zero without tokens)."""
    import xxhash

    def run(texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), size), np.float32)
        for row, text in zip(out, texts, strict=True):
            for term in lexical.query_terms(text):
                h = xxhash.xxh64_intdigest(term)
                row[h % size] += 1 if h >> 63 else -1
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.divide(out, norm, out=np.zeros_like(out), where=norm > 0)

    return run


def hashed_encoder(texts: DataFrame, text: str, out: str = "embedding") -> DataFrame:
    """texts with a vector from the stand-in encoder; a null text has that of an empty one."""
    return texts.withColumn(out, encoder(hashed_model)(F.col(text)))


def _met(left: DataFrame, right: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    return left.alias("l").join(right.alias("r"), [F.col(f"l.{k}").eqNullSafe(F.col(f"r.{k}")) for k in on], how)


def resolve_hits(hits: DataFrame, current: DataFrame, versions: DataFrame, day: Column, limit: int) -> DataFrame:
    """Hits (doc_id, score) on current rows re-resolved to the versions in force on a day, with these' columns: one batch join in place of a look-up a hit.

    Scores and order stay those of the current rows; units without a version that day drop out and aren't refilled.
    """
    ranked = hits.join(current.select(F.col("id").alias("doc_id"), *KEY), "doc_id")
    met = _met(F.broadcast(ranked), versions.where(in_force(day)), KEY)  # at most `limit` * RECALL rows
    return met.orderBy(F.desc("score"), "doc_id", "r.id").limit(limit).select("doc_id", "score", *[F.col(f"r.{c}") for c in versions.columns])


def search(
    articles: DataFrame, query: str, arm: str = "dense", limit: int = 10, as_of: Column | None = None, vectors: DataFrame | None = None, query_vector: list[float] | None = None, texts: DataFrame | None = None
) -> DataFrame:
    """(article_pk, score, text) of one arm over current rows; with as_of, three times as many are recalled, re-resolved and cut.

    articles: one row an id, used several times (write it, if it's costly). Where these come without content but with loaded_at, texts (id, loaded_at, content) holds it, deliveries may be
    repeated there: tokens are counted where texts are read (if texts tells is_current too, of these only), and only those of the hits are ever joined.
    """
    if arm not in ARMS:
        raise ValueError(f"arm must be one of {ARMS}")
    at = ["id"] if texts is None else ["id", "loaded_at"]
    texts = articles if texts is None else texts
    scanned, texts = (texts.where("is_current") if "is_current" in texts.columns else texts), texts.select(*at, "content")
    current = articles.where("is_current")
    recall = limit * RECALL if as_of is not None else limit
    if arm == "bm25":
        posted = postings(scanned.select(F.struct(*at).alias("row"), "content"), "row", "content", lexical.query_terms(query))
        own = _met(posted.select("doc_id.*", "token_id", "first", "weight"), current.select(*at), at, "left_semi").distinct()
        hits = _scored(own.withColumnRenamed("id", "doc_id"), current.agg(F.count(F.lit(1))), recall)
    else:
        if vectors is None or query_vector is None:
            raise ValueError("the dense arm needs vectors and the query's vector")
        hits = dense_search(vectors.join(current.select("id"), "id", "left_semi"), "id", "embedding", query_vector, recall)
    if as_of is None:
        rows = F.broadcast(hits).join(current.withColumn("doc_id", F.col("id")), "doc_id").select("doc_id", "score", *at)
    else:
        rows = resolve_hits(hits, current, articles.select(*KEY, "valid_from", "valid_to", *at), as_of, limit).select("doc_id", "score", *at)
    shown = _met(F.broadcast(rows), texts, at).select("doc_id", "score", F.col("l.id").alias("article_pk"), F.col("content").alias("text"))
    shown = shown.dropDuplicates(["article_pk", "doc_id"])  # at most `limit` rows, as often as they were delivered
    return shown.orderBy(F.desc("score"), "doc_id").select("article_pk", "score", "text")


def two_arms(dense: DataFrame, bm25: DataFrame) -> DataFrame:
    """Both arms side by side, each with its own scores."""
    return dense.withColumn("arm", F.lit("dense")).unionByName(bm25.withColumn("arm", F.lit("bm25")))


def api_hits(hits: DataFrame, limit: int = 5) -> DataFrame:
    """What a service shows: rounded score and the text's first line, 20 hits at most."""
    return hits.limit(min(limit, API_LIMIT)).select("article_pk", F.round("score", 4).alias("score"), first_line("text").alias("head"))

