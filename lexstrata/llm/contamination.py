"""Evaluation texts leaking into training text: a generalised suffix automaton of the test items.

Items and documents are compared in the consistent form of `normalize`, lower case, letters and digits only. The
automaton of the items knows for each of its states which items hold its strings. A document is streamed
through it, the length of the longest match ending at each place being tracked; wherever it reaches the limit, the items of
the state that holds the last `limit` characters have leaked.

A match of `limit` characters covers one of the places probed at a stride of limit - seed + 1 with its whole seed, so
streaming starts only at probes whose seed the automaton knows (a prefilter that loses nothing), and from there exactly as far as matches reach.

Items go into automata of at most BLOCK_CHARS characters. If one holds them all, it is broadcast. Else the corpus is passed
once for its probes, of which those leave whose hashes may be a seed's; met with the seeds of all items they tell which
documents have to go through which automata, and only these documents are sent there, spread by SALT_CHARS.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.llm.longspans import RollingHash, filter_bits, filter_of, maybe_in
from lexstrata.llm.normalize import BatchSql, form_of, letters_sql, with_sql
from lexstrata.session import cut_lineage, spread

MIN_RUN = 50
BLOCK_CHARS = 250_000
SALT_CHARS = 4_000_000  # characters of documents that go through one automaton in one group
_SHIFT = 21  # a code point's bits


def probing(limit: int) -> tuple[int, int]:
    """(length of a seed, stride): of places a stride apart, one begins a seed that lies whole in a match of `limit` characters."""
    seed = max(1, limit // 2)
    return seed, limit - seed + 1


class ItemAutomaton:
    """Generalised suffix automaton of the items' characters; transitions in one dict keyed by state and character."""

    def __init__(self, items: list[tuple[int, str]], limit: int = MIN_RUN):
        self.limit, (self.seed, self.stride) = limit, probing(limit)
        self.step: dict[int, int] = {}
        self.link, self.length = [-1], [0]
        self._out: list[set[str]] = [set()]
        ends: list[tuple[int, int]] = []
        for item, text in items:
            last = 0
            for c in text:
                last = self._extend(last, c)
                ends.append((last, item))
        self._settle(ends, [text for _, text in items])

    def _new(self, length: int, link: int, out: set[str]) -> int:
        self.length.append(length)
        self.link.append(link)
        self._out.append(out)
        return len(self.length) - 1

    def _clone(self, p: int, q: int, c: str) -> int:
        fresh = self._new(self.length[p] + 1, self.link[q], set(self._out[q]))
        for x in self._out[q]:
            self.step[fresh << _SHIFT | ord(x)] = self.step[q << _SHIFT | ord(x)]
        self.link[q] = fresh
        while p != -1 and self.step.get(p << _SHIFT | ord(c)) == q:
            self.step[p << _SHIFT | ord(c)] = fresh
            p = self.link[p]
        return fresh

    def _extend(self, last: int, c: str) -> int:
        code = ord(c)
        if (q := self.step.get(last << _SHIFT | code)) is not None:
            return q if self.length[q] == self.length[last] + 1 else self._clone(last, q, c)
        fresh, p = self._new(self.length[last] + 1, 0, set()), last
        while p != -1 and (p << _SHIFT | code) not in self.step:
            self.step[p << _SHIFT | code] = fresh
            self._out[p].add(c)
            p = self.link[p]
        if p != -1:
            q = self.step[p << _SHIFT | code]
            self.link[fresh] = q if self.length[q] == self.length[p] + 1 else self._clone(p, q, c)
        return fresh

    def _settle(self, ends: list[tuple[int, int]], texts: list[str]) -> None:
        """Items of each state (of strings of at least the limit), and the states that the seeds reach."""
        del self._out
        items: dict[int, set[int]] = {}
        for state, item in ends:
            if self.length[state] >= self.limit:
                items.setdefault(state, set()).add(item)
        for v in sorted((v for v in range(len(self.length)) if self.length[v] >= self.limit), key=self.length.__getitem__, reverse=True):
            if v in items and self.length[self.link[v]] >= self.limit:
                items.setdefault(self.link[v], set()).update(items[v])
        #: the state that holds the last `limit` characters, from any state beyond
        self.at_limit: dict[int, int] = {}
        for v in sorted((v for v in range(len(self.length)) if self.length[v] >= self.limit), key=self.length.__getitem__):
            up = self.link[v]
            self.at_limit[v] = v if self.length[up] < self.limit else self.at_limit[up]
        self.items = {v: tuple(sorted(items.get(v, ()))) for v in set(self.at_limit.values())}
        k = self.seed
        self.seeds = {t[i : i + k] for t in texts for i in range(len(t) - k + 1)}

    def matches(self, text: str) -> Iterator[tuple[int, int, tuple[int, ...]]]:
        """(end, length, items): the longest match ending before `end`, wherever it reaches the limit."""
        n, k, i, seeds, step, link, length = len(text), self.seed, 0, self.seeds, self.step, self.link, self.length
        while i + k <= n:
            if text[i : i + k] not in seeds:
                i += self.stride
                continue
            j, v, size = max(0, i - self.stride + 1), 0, 0
            while j < n:
                code = ord(text[j])
                while v and (v << _SHIFT | code) not in step:
                    v = link[v]
                    size = length[v]
                if (to := step.get(v << _SHIFT | code)) is not None:
                    v, size = to, size + 1
                j += 1
                if size >= self.limit:
                    yield j, size, self.items[self.at_limit[v]]
                elif j >= i + k and size < k:
                    break
            i = j

    def spans(self, text: str) -> tuple[list[tuple[int, int]], set[int]]:
        """Merged [start, end) of all matches that reach the limit, and the items they show."""
        out: list[list[int]] = []
        shown: set[int] = set()
        for end, size, items in self.matches(text):
            shown.update(items)
            start = end - size
            while out and start <= out[-1][0]:
                out.pop()
            if out and start <= out[-1][1]:
                out[-1][1] = end
            else:
                out.append([start, end])
        return [(a, b) for a, b in out], shown


def merged_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Overlapping and adjoining [start, end) joined, as one automaton of all items gives them."""
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], max(b, out[-1][1])
        else:
            out.append((a, b))
    return out


_CLUSTER = re.compile(r"[\s\S](?:[̀-ͯ᪰-᫿᷀-᷿⃐-⃿︠-︯ᅠ-ᇿ゙゚­​-‏⁠-⁤﻿]+)?")


def original_places(text: str) -> list[tuple[int, int]]:
    """For each character of the text's letters-and-digits form, [start, end) of what it came from in the text."""
    out: list[tuple[int, int]] = []
    for m in _CLUSTER.finditer(text):
        made = "".join(c for c in form_of(m.group()).lower() if unicodedata.category(c)[0] in "LN")
        out += [m.span()] * len(made)
    return out


def without_spans(text: str, folded_chars: int, spans: list[tuple[int, int]], max_coverage: float) -> tuple[str | None, list[tuple[int, int]] | None, str]:
    """The text without the spans (given in its folded form), the places cut out, and the outcome: 'cut'; 'covered' (no text) if they cover more than max_coverage of it; 'unplaced' (neither) if its places can't be told."""
    if sum(b - a for a, b in spans) > max_coverage * folded_chars:
        return None, [(0, len(text))], "covered"
    places = original_places(text)
    if len(places) != folded_chars:
        return None, None, "unplaced"
    cut = [(places[a][0], places[b - 1][1]) for a, b in spans]
    kept, last = [], 0
    for a, b in cut:
        kept.append(text[last:a])
        last = max(last, b)
    kept.append(text[last:])
    return "".join(kept), cut, "cut"


_PLACES = pa.list_(pa.struct([("start_at", pa.int32()), ("end_at", pa.int32())]))
_PLACES_SQL = "array<struct<start_at int, end_at int>>"
FOUND_SCHEMA = f"id long, text string, chars int, copies long, items array<long>, spans {_PLACES_SQL}"
CLEANED_SCHEMA = f"doc_id long, items array<long>, cut {_PLACES_SQL}, cleaned string, outcome string"


def _found_rows(automaton: ItemAutomaton, rows: list[tuple], clean: bool) -> pa.RecordBatch | None:
    """rows: (id, text, folded text, copies)."""
    out: list[tuple] = []
    for doc, text, folded, copies in rows:
        spans, items = automaton.spans(folded)
        if items and clean:
            out.append((doc, text, len(folded), copies, sorted(items), [{"start_at": a + 1, "end_at": b} for a, b in spans]))
        else:
            out += [(doc, x) for x in sorted(items)]
    if not out:
        return None
    kinds = [pa.int64(), pa.string(), pa.int32(), pa.int64(), pa.list_(pa.int64()), _PLACES] if clean else [pa.int64()] * 2
    names = ["id", "text", "chars", "copies", "items", "spans"] if clean else ["doc_id", "item_id"]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], names)


class _Stream:
    """Arrow batches (id, text) of documents against one broadcast automaton; clean: with the text, the length of its folded form and the spans there."""

    def __init__(self, automaton, clean: bool):
        self.automaton, self.clean = automaton, clean

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = self.automaton.value
        for rows in BatchSql({"folded": letters_sql("text")}, ["id", "text"] if self.clean else ["id"]).run(batches):
            texts = rows["text"] if self.clean else [None] * rows.num_rows
            found = _found_rows(automaton, [(i, t if t is None else t.as_py(), f, 1) for i, t, f in zip(rows["id"].to_pylist(), texts, rows["folded"].to_pylist(), strict=True)], self.clean)
            if found is not None:
                yield found


def _seed_hashes(texts: list[str], seed: int, stride: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, hash) of the seeds that begin in each text at a stride."""
    lengths = np.array([len(t) for t in texts], np.int64)
    counts = np.maximum(0, (lengths - seed) // stride + 1) * (lengths >= seed)
    row = np.repeat(np.arange(len(texts)), counts)
    if not len(row):
        return row, np.zeros(0, np.int64)
    at = (np.cumsum(lengths) - lengths)[row] + (np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)) * stride
    rolling = RollingHash(np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32))
    return row, rolling.between(at, at + seed).view(np.int64)


class _Seeds:
    """Folded items (block, folded) to (h, block) of all their seeds."""

    def __init__(self, seed: int):
        self.seed = seed

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            row, h = _seed_hashes(batch.column(1).to_pylist(), self.seed, 1)
            if len(h):
                yield pa.RecordBatch.from_arrays([pa.array(h), batch.column(0).take(pa.array(row))], ["h", "block"])


class _Probes:
    """Documents (doc, sig, text) to the probes whose hash the broadcast bitmap (slot: octets) holds: (doc, sig, chars, h), each once a text."""

    def __init__(self, bitmap, bits: int, limit: int):
        self.bitmap, self.bits, (self.seed, self.stride) = bitmap, bits, probing(limit)

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        flags = self.bitmap.value
        for rows in BatchSql({"folded": letters_sql("text")}, ["doc", "sig"]).run(batches):
            texts = rows["folded"].to_pylist()
            chars = np.array([len(t) for t in texts], np.int64)
            row, h = _seed_hashes(texts, self.seed, self.stride)
            spot = h & (self.bits - 1)
            some = (flags[spot >> 3] >> (spot & 7).astype(np.uint8)) & 1 == 1
            pairs = np.unique(np.stack([row[some], h[some]]), axis=1)
            if pairs.shape[1]:
                at = pa.array(pairs[0])
                columns = [rows["doc"].combine_chunks().take(at), rows["sig"].combine_chunks().take(at), pa.array(chars[pairs[0]]), pa.array(pairs[1])]
                yield pa.RecordBatch.from_arrays(columns, ["doc", "sig", "chars", "h"])


class _Group:
    """A block's items and some of the documents that may hold one of them, to what is found."""

    def __init__(self, limit: int, clean: bool, schema: pa.Schema):
        self.limit, self.clean, self.schema = limit, clean, schema

    def __call__(self, docs: pa.Table, items: pa.Table) -> pa.Table:
        found = []
        if docs.num_rows and items.num_rows:
            items = items.sort_by([("id", "ascending"), ("folded", "ascending")])
            automaton = ItemAutomaton(list(zip(items["id"].to_pylist(), items["folded"].to_pylist(), strict=True)), self.limit)
            for rows in docs.combine_chunks().to_batches(max_chunksize=1000):
                texts = rows["text"].to_pylist() if self.clean else [None] * rows.num_rows
                batch = _found_rows(automaton, list(zip(rows["doc"].to_pylist(), texts, rows["folded"].to_pylist(), rows["copies"].to_pylist(), strict=True)), self.clean)
                found += [] if batch is None else [batch]
        return pa.Table.from_batches(found, self.schema)


class _Cut:
    """What was found in whole documents to what to do about them."""

    def __init__(self, max_coverage: float):
        self.max_coverage = max_coverage

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.list_(pa.int64()), _PLACES, pa.string(), pa.string()]
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                spans = merged_spans([(x["start_at"] - 1, x["end_at"]) for x in r["spans"]])
                cleaned, cut, outcome = without_spans(r["text"], r["chars"], spans, self.max_coverage)
                row = (r["id"], sorted(set(r["items"])), cut and [{"start_at": a + 1, "end_at": b} for a, b in cut], cleaned, outcome)
                out += [row] * r["copies"]  # a document that stands repeated stays so
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), kinds, strict=True)], ["doc_id", "items", "cut", "cleaned", "outcome"])


def folded_items(items: DataFrame, item_id: str, text: str, limit: int) -> DataFrame:
    """(id, folded): the items that are long enough to leak, each text of an id once."""
    picked = items.where(F.col(item_id).isNotNull() & F.col(text).isNotNull()).select(F.col(item_id).cast("long").alias("id"), F.col(text).alias("t")).distinct()
    return with_sql(picked, {"folded": letters_sql("t")}, ["id"]).where(F.length("folded") >= limit)


def in_blocks(folded: DataFrame, total: int, block_chars: int) -> DataFrame:
    """Items with a block of about block_chars characters each (a single longer item is a block of its own): running sums within hash classes, which are of bounded size on average."""
    classes = -(-2 * total // block_chars)
    w = W.partitionBy("class").orderBy("id", "folded").rowsBetween(W.unboundedPreceding, -1)
    placed = folded.withColumn("class", F.pmod(F.xxhash64("id", "folded"), F.lit(classes)))
    nth = F.floor(F.coalesce(F.sum(F.length("folded")).over(w), F.lit(0)) / block_chars)
    return placed.select((F.col("class") * (1 << 31) + nth).alias("block"), "id", "folded")


def _spread(docs: DataFrame, items: DataFrame, total: int, limit: int, clean: bool, schema: str) -> DataFrame:
    """What is found where the items need several automata; docs: (id, text), items: (block, id, folded), written."""
    spark = docs.sparkSession
    seeds = items.select("block", "folded").mapInArrow(_Seeds(probing(limit)[0]), "h long, block long").distinct()
    bits = filter_bits(total)
    flags = np.zeros(bits >> 3, np.uint8)
    for r in filter_of(seeds.select((F.col("h").bitwiseAND(F.lit(bits - 1)) + 1).alias("spot"))).toLocalIterator():  # bits / 8 octets at most, whatever the items
        flags[(r["slot"] - 1) * 4096 : r["slot"] * 4096] = np.frombuffer(r["flags"], np.uint8)
    picked = docs.select(F.col("id").alias("doc"), F.xxhash64("text").alias("sig"), "text")
    probes = spread(picked).mapInArrow(_Probes(spark.sparkContext.broadcast(flags), bits, limit), "doc long, sig long, chars long, h long")
    hits = cut_lineage(probes.join(seeds, "h").select("doc", "sig", "chars", "block").distinct())
    salts = hits.groupBy("block").agg(F.ceil(F.sum("chars") / SALT_CHARS).cast("int").alias("salts"))
    n = hits.agg(F.count_distinct("doc")).first()[0]
    once = maybe_in(picked, hits.select("doc"), filter_bits(n)).groupBy("doc", "sig").agg(F.any_value("text").alias("text"), F.count(F.lit(1)).alias("copies"))
    own = ["doc", *(["text"] if clean else []), "copies"]
    sent = with_sql(once, {"folded": letters_sql("text")}, ["sig", *own]).join(hits, ["doc", "sig"]).join(salts, "block").select("block", F.pmod(F.xxhash64("doc", "sig", F.lit("salt")), "salts").cast("int").alias("salt"), *own, "folded")
    given = items.join(salts, "block").select("block", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "id", "folded")
    arrow = pa.schema([("id", pa.int64()), ("text", pa.string()), ("chars", pa.int32()), ("copies", pa.int64()), ("items", pa.list_(pa.int64())), ("spans", _PLACES)]) if clean else pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64())])
    run = _Group(limit, clean, arrow)
    return sent.groupBy("block", "salt").cogroup(given.groupBy("block", "salt")).applyInArrow(lambda left, right: run(left, right), schema)


def _streamed(docs, doc_id, text, items, item_id, item_text, limit, block_chars, clean, schema) -> tuple[DataFrame, bool]:
    """(what is found, whether several automata may have found something in one document)."""
    spark = docs.sparkSession
    picked = docs.where(F.col(doc_id).isNotNull() & F.col(text).isNotNull()).select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text"))
    folded = folded_items(items, item_id, item_text, limit)
    total = folded.agg(F.sum(F.length("folded"))).first()[0] or 0
    if total > block_chars:
        return _spread(picked, cut_lineage(in_blocks(folded, total, block_chars)), total, limit, clean, schema), True
    if not total:
        return spark.createDataFrame([], schema), False
    block = [(r["id"], r["folded"]) for r in folded.orderBy("id", "folded").collect()]
    return spread(picked).mapInArrow(_Stream(spark.sparkContext.broadcast(ItemAutomaton(block, limit)), clean), schema), False


def leaked_items(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = MIN_RUN, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """(doc_id, item_id), distinct: documents that hold at least `limit` consecutive letters and digits of an item.

    Null ids and null texts are left out; items shorter than the limit can't leak; an empty table gives no rows.
    Documents are taken whole. With one automaton nothing of them is shuffled but the result; with several the corpus is passed twice,
    for the probes and for the texts of the documents whose probes met a seed, whatever the number of automata.
    """
    return _streamed(docs, doc_id, text, items, item_id, item_text, limit, block_chars, False, "doc_id long, item_id long")[0].distinct()


def leaking_documents(docs: DataFrame, items: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", limit: int = MIN_RUN, max_coverage: float = 0.5, block_chars: int = BLOCK_CHARS) -> DataFrame:
    """Leaking documents with what to do about them: (doc_id, items, cut, cleaned, outcome), a row for each that leaks, whatever the number of automata.

    cut: the stretches (from 1, both included) of the text as stored that hold matched runs; cleaned: the text without
    them. outcome: 'cut'; 'covered' where they cover more than max_coverage of its letters and digits, i.e. the document should
    go (cleaned null, cut the whole text); 'unplaced' where the places in the text as stored can't be told (both null).
    With several automata the leaking documents, and only these, are shuffled with what each automaton found.
    """
    found, several = _streamed(docs, doc_id, text, items, item_id, item_text, limit, block_chars, True, FOUND_SCHEMA)
    if several:
        found = found.groupBy("id", "text", "chars", "copies").agg(F.flatten(F.collect_list("items")).alias("items"), F.flatten(F.collect_list("spans")).alias("spans"))
    return found.mapInArrow(_Cut(max_coverage), CLEANED_SCHEMA)
