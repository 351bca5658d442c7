"""Long exact spans shared between records: recompression gives equal passages equal interior symbols.

Rounds of recompression rename every document's characters: a short run of equal symbols becomes one symbol, then each pair
of neighbours of which the first is in the round's left class and the second in its right class becomes one. Names are 64-bit
hashes of what they stand for and the classes are a bit of the name, so the naming is the same all over the cluster
without a dictionary to shuffle. What a round may join is bounded in characters (STEPS), runs too, longer ones staying
apart; so whether a symbol begins at a place, and its name, depend on the REACH[0] characters before that place and
the REACH[1] from it on, and on nothing else: a passage that occurs in several documents has the same symbols in all of them but
for those ends, whatever stands around it.

Each window of `least` characters is known by its anchor: of the symbols that begin in its middle, that with the least
name (the last of equals). An anchor's key is the sequence of the symbols around it that are certain in every window of that anchor.
The first pass emits keys; those that occur in one document only are done with. For the others the second
pass sends the text of their windows, keyed alike; where several documents meet, equal windows are found by
their hashes, compared character by character, and joined to stretches.

No pairs are formed: a key's group is passed once. What several documents of one batch share is settled before the shuffle,
all but one of them leave the group (that one says that it is shared, whatever its own id), so copies and boilerplate held by a third of all documents come down to a row a
batch; a key with more than HOT_ROWS rows and 1/HOT_SHARE of all is spread by its single windows' hashes. Neighbouring
anchors of one key, as rulers and other repetitions have them, are one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from lexstrata.session import cut_lineage, spread

LEAST = 200
#: Of each round the longest run, in characters, that becomes one symbol, and the longest symbol that may be paired.
STEPS = ((3, 3), (4, 5), (6, 6))
#: Characters before a place, and from it on, on which the symbol that begins there depends. Whether a run stays within its bound is told
#: by symbols that begin at most that bound away, whether a symbol ends a pair by one that begins at most a pairable symbol's length before.
REACH = (sum(map(sum, STEPS)), sum(map(sum, STEPS)) + 1)
HOT_ROWS = 20_000
HOT_SHARE = 2_000
CHUNK_CHARS = 400_000
FILTER_BITS = 1 << 15, 1 << 28  # of the filter of sharing documents: at least, at most (32 MB)
_PLACE = 22  # bits of a place in a buffer

_U = np.uint64
_M1, _M2, _BASE = _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0x9E3779B97F4A7C15)
_SALTS = [_U((0x9E3779B97F4A7C15 * (2 * r + 3)) % (1 << 64) | 1) for r in range(64)]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _M1
    x ^= x >> _U(27)
    x *= _M2
    x ^= x >> _U(31)
    return x


class _Powers:
    """Powers of a number modulo 2**64, grown as needed."""

    def __init__(self, base: int):
        self.base, self.values = _U(base), np.ones(1, np.uint64)

    def upto(self, n: int) -> np.ndarray:
        if len(self.values) <= n:
            p = np.full(max(n + 1, CHUNK_CHARS + 1), self.base, np.uint64)
            p[0] = 1
            self.values = np.multiply.accumulate(p)
        return self.values[: n + 1]


_POWERS, _INVERSES = _Powers(int(_BASE)), _Powers(pow(int(_BASE), -1, 1 << 64))


class RollingHash:
    """Hashes of all substrings of a buffer of code points: of what lies in [i, j) by two look-ups."""

    def __init__(self, points: np.ndarray):
        n = len(points)
        self.inverse = _INVERSES.upto(n)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mix(points.astype(np.uint64) + _BASE) * _POWERS.upto(n)[:n], out=self.sums[1:])

    def between(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Equal for equal substrings of any buffers: the base's inverse takes each to the origin."""
        return _mix((self.sums[ends] - self.sums[starts]) * self.inverse[starts])


def recompress(points: np.ndarray, firsts: np.ndarray, steps: tuple[tuple[int, int], ...] = STEPS) -> tuple[np.ndarray, np.ndarray]:
    """(name, start) of the symbols of a buffer of several texts after all rounds; firsts: where the texts begin."""
    name = _mix(points.astype(np.uint64) * _M2 + _BASE)
    start = np.arange(len(points), dtype=np.int64)
    size = np.ones(len(points), np.int64)
    first = np.zeros(len(points), bool)
    first[firsts] = True

    def joined(gone: np.ndarray) -> tuple[np.ndarray, ...]:
        keep = np.ones(len(name), bool)
        keep[gone] = False
        return name[keep], start[keep], size[keep], first[keep]

    for r, (run_chars, pair_chars) in enumerate(steps):
        # runs
        equal = np.flatnonzero((name[1:] == name[:-1]) & ~first[1:]) + 1
        if len(equal):
            new = np.r_[True, equal[1:] != equal[:-1] + 1]
            head = equal[new] - 1
            count = np.diff(np.r_[np.flatnonzero(new), len(equal)]) + 1
            short = count * size[head] <= run_chars
            gone = equal[np.repeat(short, count - 1)]
            head, count = head[short], count[short]
            name[head] = _mix(name[head] + count.astype(np.uint64) * _M1)
            size[head] *= count
            name, start, size, first = joined(gone)
        # pairs
        right = (name * _SALTS[r]) >> _U(63) == 1
        free = size <= pair_chars
        left = free & ~right
        right &= free & ~first
        at = np.flatnonzero(left[:-1] & right[1:])
        name[at] = _mix(name[at] * _M1 + name[at + 1] * _M2 + _SALTS[r])
        size[at] += size[at + 1]
        name, start, size, first = joined(at + 1)
    return name, start


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each `width` neighbouring values, by the running minima of blocks from both sides."""
    n = len(values) - width + 1
    padded = np.full(-(-len(values) // width) * width, np.iinfo(np.uint64).max, np.uint64)
    padded[: len(values)] = values
    blocks = padded.reshape(-1, width)
    ahead = np.minimum.accumulate(blocks, axis=1).ravel()
    back = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


class Anchors:
    """The anchors of all windows of a buffer of texts: for each its text, its place, its window starts lo..hi, and its key.

    A window that begins at x takes its anchor from the symbols that begin in x + margin .. x + margin + middle - 1; every
    window of an anchor holds all on which the symbols depend that begin from `around` before it to `around` behind it.
    """

    def __init__(self, texts: list[str], least: int, steps: tuple[tuple[int, int], ...] = STEPS):
        self.least = least
        middle = least * 3 // 10
        around = (least + 1 - sum(REACH) - middle) // 2
        margin = REACH[0] + around
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        ends = np.cumsum(lengths)
        self.begins = ends - lengths
        none = np.zeros(0, np.int64)
        self.owner = self.place = self.lo = self.hi = self.key = none
        if not len(points) or len(points) < least:
            return
        if len(points) >> _PLACE:
            raise ValueError("a buffer too long for its places")
        name, start = recompress(points, self.begins[lengths > 0], steps)
        # symbols in the order of their names, later ones first among equals
        order = np.full(len(points), np.iinfo(np.uint64).max, np.uint64)
        mask = _U((1 << _PLACE) - 1)
        order[start] = (name & ~mask) | (mask - start.astype(np.uint64))
        low = _sliding_least(order, middle)
        window = np.concatenate([np.arange(a, b - least + 1) for a, b in zip(self.begins, ends, strict=True)]) if len(texts) else none
        if not len(window):
            return
        place = (mask - (low[window + margin] & mask)).astype(np.int64)
        head = np.flatnonzero(np.r_[True, (place[1:] != place[:-1]) | (np.diff(window) != 1)])
        self.place, self.lo, self.hi = place[head], window[head], window[np.r_[head[1:], len(window)] - 1]
        self.owner = np.searchsorted(ends, self.place, side="right")
        # the sequence of symbols around the anchor, and where in it the anchor is
        i, j = np.searchsorted(start, self.place - around), np.searchsorted(start, self.place + around, side="right")
        symbols = RollingHash(name)
        self.key = _mix(symbols.between(i, j) + (self.place - start[i]).astype(np.uint64) * _M1).view(np.int64)
        self._join_repetitions()

    def _join_repetitions(self) -> None:
        """Neighbouring anchors of one key become one, known by the first; of window starts at most 2**15 apart."""
        part = (self.lo - self.begins[self.owner]) >> 15
        same = (self.key[1:] == self.key[:-1]) & (self.owner[1:] == self.owner[:-1]) & (self.lo[1:] == self.hi[:-1] + 1) & (part[1:] == part[:-1])
        head = np.flatnonzero(np.r_[True, ~same])
        self.hi = self.hi[np.r_[head[1:], len(same) + 1] - 1]
        self.owner, self.place, self.lo, self.key = self.owner[head], self.place[head], self.lo[head], self.key[head]


def _segments(texts: list[str | None], least: int, most: int = CHUNK_CHARS) -> tuple[list[str], np.ndarray, np.ndarray]:
    """(pieces, row, offset): texts longer than `most` in pieces that overlap by least - 1 characters, so that each window lies whole in at least one."""
    pieces, row, offset = [], [], []
    for i, t in enumerate(texts):
        for a in range(0, max(1, len(t) - least + 1), most):
            pieces.append(t if len(t) <= most else t[a : a + most + least - 1])
            row.append(i)
            offset.append(a)
            if len(t) <= most:
                break
    return pieces, np.array(row, np.int64), np.array(offset, np.int64)


def _chunks(texts: list[str]) -> Iterator[tuple[int, int]]:
    begin, chars = 0, 0
    for i, t in enumerate(texts):
        chars += len(t)
        if chars >= CHUNK_CHARS:
            yield begin, i + 1
            begin, chars = i + 1, 0
    if begin < len(texts):
        yield begin, len(texts)


def _settle(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(known, spare, size): rows whose key another document of the batch has too; those of them that needn't stay in the key's group because another row of the same key does; rows of the same key."""
    order = np.argsort(key, kind="stable")
    k, d = key[order], doc[order]
    cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
    size = np.diff(np.r_[cut, len(k)])
    shared = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
    known, spare, rows = np.zeros(len(k), bool), np.ones(len(k), bool), np.zeros(len(k), np.int64)
    known[order], rows[order] = np.repeat(shared, size), np.repeat(size, size)
    spare[order[cut]] = False
    return known, known & spare, rows


def _own_keys(doc: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Keys of rows that need no company."""
    return _mix(_mix(doc.astype(np.uint64)) + place.astype(np.uint64)).view(np.int64)


#: weight: how many rows of the batch a row stands for in its key's group; negative if it's known to be shared, 0 if another row stands for it.
FIRST_SCHEMA = "core long, doc long, sig long, at int, span int, weight int"


class _FirstPass:
    """(doc, sig, text) to anchors. span packs the window starts: (at - lo) and (hi - lo)."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            docs, sigs = batch.column("doc").to_numpy(), batch.column("sig").to_numpy()
            texts, row_of, offset = _segments(batch.column("text").to_pylist(), self.least)
            parts = []
            for a, b in _chunks(texts):
                x = Anchors(texts[a:b], self.least)
                piece = x.owner + a
                parts.append((x.key, row_of[piece], x.place - x.begins[x.owner] + offset[piece], (x.place - x.lo) << 16 | (x.hi - x.lo)))
            if not parts or not any(len(p[0]) for p in parts):
                continue
            key, row, at, span = (np.concatenate(c) for c in zip(*parts, strict=True))
            doc, sig = docs[row], sigs[row]
            known, spare, size = _settle(key, doc)
            weight = np.where(spare, 0, np.where(known, -size, 1))
            columns = [key, doc, sig, at.astype(np.int32), span.astype(np.int32), weight.astype(np.int32)]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["core", "doc", "sig", "at", "span", "weight"])


#: shared: whether another document of the batch has the same text, so that whatever equals it is shared, also under the same id.
SECOND_SCHEMA = "key long, doc long, lo int, n int, text string, shared boolean"


class _SecondPass:
    """(doc, text, anchors) to window groups: key, first window start, number of windows, and their text (null: known to be shared)."""

    def __init__(self, least: int, hot: frozenset[int]):
        self.least, self.hot = least, hot

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        least = self.least
        for batch in batches:
            docs, texts = batch.column("doc").to_pylist(), batch.column("text").to_pylist()
            key, doc, lo, n, text = [], [], [], [], []
            for d, t, anchors in zip(docs, texts, batch.column("anchors").to_pylist(), strict=True):
                for a in anchors:
                    first, more = a["at"] - (a["span"] >> 16), a["span"] & 0xFFFF
                    if a["core"] not in self.hot:
                        key.append(a["core"])
                        doc.append(d)
                        lo.append(first)
                        n.append(more + 1)
                        text.append(t[first : first + more + least])
                        continue
                    for s in range(first, first + more + 1):  # a hot anchor: by single windows
                        w = t[s : s + least]
                        key.append(hash_text(w))
                        doc.append(d)
                        lo.append(s)
                        n.append(1)
                        text.append(w)
            if key:
                yield self._rows(key, doc, lo, n, text)

    def _rows(self, key, doc, lo, n, text) -> pa.RecordBatch:
        """Of equal texts in several documents of the batch, all but one are settled and lose their text."""
        table = pa.table({"k": pa.array(key, pa.int64()), "t": pa.array(text)})
        code = pa.compute.dictionary_encode(table["t"].combine_chunks()).indices.to_numpy().astype(np.int64)
        owner = np.array(doc, np.int64)
        known, spare, _ = _settle(code, owner)
        keys, starts = np.array(key, np.int64), np.array(lo, np.int64)
        # the one that stays is settled as well: it leaves a second row that says so
        stay = known & ~spare
        keys = np.where(spare, _own_keys(owner, starts), keys)
        texts = pa.array(text).filter(pa.array(~spare))
        keep, extra = np.flatnonzero(~spare), np.flatnonzero(stay)
        none = np.flatnonzero(spare)
        count = np.array(n, np.int64)
        order = np.r_[keep, none, extra]
        kk = np.r_[keys[keep], keys[none], _own_keys(owner[extra], starts[extra])]
        tt = pa.concat_arrays([texts, pa.nulls(len(none) + len(extra), pa.string())])
        return pa.RecordBatch.from_arrays([pa.array(kk), pa.array(owner[order]), pa.array(starts[order].astype(np.int32)), pa.array(count[order].astype(np.int32)), tt, pa.array(known[order])], ["key", "doc", "lo", "n", "text", "shared"])


def hash_text(text: str) -> int:
    import xxhash

    return int(np.int64(np.uint64(xxhash.xxh3_64_intdigest(text))))


class _Meet:
    """Sorted (key, doc, lo, n, text, shared) to shared window ranges (doc, start, end): passes each key's group once."""

    def __init__(self, least: int):
        self.least = least

    def __call__(self, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            key = batch.column("key").to_numpy()
            # what follows the last change of key waits for its group's end
            cut = int(np.searchsorted(key, key[-1]))
            if cut:
                yield self._of(pa.Table.from_batches([*held, batch.slice(0, cut)]))
                held = [batch.slice(cut)]
            elif held and held[-1].column("key")[0].as_py() != key[0]:
                yield self._of(pa.Table.from_batches(held))
                held = [batch]
            else:
                held.append(batch)
        if held:
            yield self._of(pa.Table.from_batches(held))

    def _of(self, rows: pa.Table) -> pa.RecordBatch:
        key, doc, lo, n = (rows[c].to_numpy().astype(np.int64) for c in ("key", "doc", "lo", "n"))
        settled = rows["text"].is_null().to_numpy()
        known = rows["shared"].to_numpy()
        out = [(doc[settled], lo[settled], lo[settled] + n[settled])]
        order = np.argsort(key, kind="stable")
        k, d = key[order], doc[order]
        cut = np.flatnonzero(np.r_[True, k[1:] != k[:-1]])
        size = np.diff(np.r_[cut, len(k)])
        many = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
        many |= np.logical_or.reduceat(known[order], cut) & (size > 1)
        open_rows = np.zeros(len(k), bool)
        open_rows[order] = np.repeat(many, size)
        open_rows &= ~settled
        picked = np.flatnonzero(open_rows)
        done = 0
        while done < len(picked):  # whole groups, about CHUNK_CHARS characters at a time
            upto = min(len(picked), done + max(1, CHUNK_CHARS // (2 * self.least)))
            while upto < len(picked) and key[picked[upto]] == key[picked[upto - 1]]:
                upto += 1
            part = picked[done:upto]
            out.append(self._compare(key[part], doc[part], lo[part], n[part], known[part], rows["text"].take(pa.array(part)).to_pylist()))
            done = upto
        doc, start, end = (np.concatenate(c) for c in zip(*out, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(start.astype(np.int32)), pa.array((end - 1 + self.least).astype(np.int32))], ["doc", "start", "end"])

    def _compare(self, key, doc, lo, n, known, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ranges of window starts [start, end) of each row that another document's row of the key, or one known to be shared, has too."""
        points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
        lengths = np.array([len(t) for t in texts], np.int64)
        begins = np.cumsum(lengths) - lengths
        total = int(n.sum())
        row = np.repeat(np.arange(len(n)), n)
        within = np.arange(total) - np.repeat(np.cumsum(n) - n, n)
        at = begins[row] + within
        mark = RollingHash(points).between(at, at + self.least)
        mark = _mix(mark + key[row].view(np.uint64))
        order = np.argsort(mark, kind="stable")
        m, d = mark[order], doc[row[order]]
        cut = np.flatnonzero(np.r_[True, m[1:] != m[:-1]])
        size = np.diff(np.r_[cut, len(m)])
        differ = np.minimum.reduceat(d, cut) < np.maximum.reduceat(d, cut)
        sure = np.minimum.reduceat(np.where(known[row[order]], np.arange(total), total), cut)
        shared = differ | (sure < total)
        # each window's counterpart: the first of its equals known to be shared, else the first in another document, else the first
        first = order[cut]
        other = order[cut + np.array([int(np.argmax(d[c : c + s] != d[c])) if h else 0 for c, s, h in zip(cut, size, differ, strict=True)])] if len(cut) else first
        certain = order[np.minimum(sure, total - 1)]
        first, other = np.where(sure < total, certain, first), np.where(sure < total, certain, other)
        same = np.zeros(total, bool)
        peer = np.zeros(total, np.int64)
        flat_first, flat_other = np.repeat(first, size), np.repeat(other, size)
        peer[order] = np.where(doc[row[order]] == doc[row[flat_first]], flat_other, flat_first)
        same[order] = np.repeat(shared, size)
        at_same = np.flatnonzero(same)
        if not len(at_same):
            none = np.zeros(0, np.int64)
            return none, none, none
        # unbroken ranges with one counterpart at one distance are compared at once
        shift = at[peer[at_same]] - at[at_same]
        fresh = np.r_[True, (np.diff(at_same) != 1) | (np.diff(shift) != 0) | (np.diff(row[at_same]) != 0)]
        heads = np.flatnonzero(fresh)
        tails = np.r_[heads[1:], len(at_same)] - 1
        a, b = at[at_same[heads]], at[at_same[tails]] + self.least
        equal = np.array([np.array_equal(points[x:y], points[x + s : y + s]) for x, y, s in zip(a, b, shift[heads], strict=True)])
        if not equal.all():  # two texts of one hash: settle this part by the texts themselves
            return self._by_text(key, doc, lo, n, known, texts)
        r = row[at_same[heads]]
        return doc[r], lo[r] + within[at_same[heads]], lo[r] + within[at_same[tails]] + 1

    def _by_text(self, key, doc, lo, n, known, texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        seen: dict[tuple[int, str], tuple[int, bool]] = {}
        windows = [((int(k), t[i : i + self.least]), int(d), int(a) + i, bool(h)) for k, d, a, c, h, t in zip(key, doc, lo, n, known, texts, strict=True) for i in range(c)]
        for w, d, _, h in windows:
            one, more = seen.get(w, (d, False))
            seen[w] = one, more or h or one != d
        hits = [(d, s) for w, d, s, _ in windows if seen[w][1]]
        d, s = (np.array(c, np.int64) for c in zip(*hits, strict=True)) if hits else (np.zeros(0, np.int64),) * 2
        return d, s, s + 1


def filter_of(spots: DataFrame) -> DataFrame:
    """(slot from 1, flags): a bitmap of (spot), whole numbers below the filter's bits, in slots of 4 KB; at most bits / 32768 rows (FILTER_BITS: 32 MB), so it may be broadcast."""
    return spots.groupBy(F.bitmap_bucket_number("spot").alias("slot")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("spot")).alias("flags"))


def maybe_in(df: DataFrame, ids: DataFrame, bits: int) -> DataFrame:
    """Rows of df whose doc may be among the ids (doc): all that are, and few others, without a shuffle of df."""
    spot = F.pmod(F.xxhash64("doc", F.lit("filter")), F.lit(bits))
    df = df.withColumn("spot", spot).withColumn("slot", F.bitmap_bucket_number("spot"))
    joined = df.join(F.broadcast(filter_of(ids.select(spot.alias("spot")))), "slot")
    octet = "cast(conv(hex(substring(flags, cast(bitmap_bit_position(spot) div 8 as int) + 1, 1)), 16, 10) as int)"
    return joined.where(F.expr(f"(shiftright({octet}, cast(bitmap_bit_position(spot) % 8 as int)) & 1) = 1")).drop("spot", "slot", "flags")


def shared_stretches(docs: DataFrame, doc_id: str = "doc_id", text: Column | str = "text", least: int = LEAST, hot_rows: int = HOT_ROWS) -> DataFrame:
    """(doc_id, start_at, span_len): every longest unbroken stretch of characters that lie in runs of at least `least`
    characters standing verbatim in another document; start_at from 1; distinct.

    Rows with a null id or text and texts shorter than `least` share nothing; a row repeated under its own id isn't another
    document; an id with several texts has the stretches of each; ids are whole numbers. Texts are taken whole.
    """
    if least < 2 * sum(REACH):
        raise ValueError(f"spans under {2 * sum(REACH)} characters have too few symbols in common for sure")
    picked = docs.where(F.col(doc_id).isNotNull()).select(F.col(doc_id).cast("long").alias("doc"), (F.col(text) if isinstance(text, str) else text).alias("text"))
    picked = picked.where(F.length("text") >= least).withColumn("sig", F.xxhash64("text"))
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    anchors = spread(picked.select("doc", "sig", "text")).mapInArrow(_FirstPass(least), FIRST_SCHEMA)
    # Rows that another one stands for go anywhere; so a key's group has at most one row a batch that several documents of it share.
    route = F.when(F.col("weight") == 0, F.xxhash64("core", "doc", "at")).otherwise(F.col("core"))
    by_key = W.partitionBy("key")
    met = anchors.withColumn("key", route).withColumn("a", F.min("doc").over(by_key)).withColumn("b", F.max("doc").over(by_key)).withColumn("rows", F.sum(F.abs("weight")).over(by_key)).withColumn("least_weight", F.min("weight").over(by_key))
    # A row of negative weight stands for several documents, so whatever shares its key is shared, also under its own id.
    met = met.where("least_weight <= 0 or a < b")
    shared = met.groupBy("doc", "sig").agg(F.collect_set(F.struct("core", "at", "span", F.col("rows").cast("int").alias("rows"))).alias("anchors"))
    shared = cut_lineage(shared)  # read three times: for the hot keys, the filter and the join
    n_texts, n_anchors = shared.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("anchors")), F.lit(0))).first()
    some = maybe_in(picked, shared.select("doc"), filter_bits(n_texts))
    rows = some.join(shared, ["doc", "sig"]).select("doc", "text", "anchors")
    windows = rows.mapInArrow(_SecondPass(least, _hot_keys(shared, max(hot_rows, n_anchors // HOT_SHARE))), SECOND_SCHEMA)
    sorted_windows = windows.repartition(parts, "key").sortWithinPartitions("key")
    ranges = sorted_windows.mapInArrow(_Meet(least), "doc long, start int, end int")
    return _joined(ranges).select(F.col("doc").alias(doc_id), (F.col("start") + 1).alias("start_at"), (F.col("end") - F.col("start")).alias("span_len"))


def filter_bits(n: int) -> int:
    """Eight to sixteen bits an id, within FILTER_BITS; beyond, the filter only lets more pass."""
    return min(max(1 << (8 * n).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])


def _hot_keys(shared: DataFrame, limit: int) -> frozenset[int]:
    """Anchors with more rows than the limit, i.e. than 1/HOT_SHARE of all: fewer than HOT_SHARE by construction."""
    each = shared.select(F.explode("anchors").alias("x")).select("x.core", "x.rows")
    return frozenset(r[0] for r in each.where(F.col("rows") > limit).select("core").distinct().collect())


def _joined(ranges: DataFrame) -> DataFrame:
    """Overlapping and adjoining [start, end) of a document joined."""
    by_doc = W.partitionBy("doc").orderBy("start", "end")
    reach = F.max("end").over(by_doc.rowsBetween(W.unboundedPreceding, -1))
    marked = ranges.withColumn("fresh", (reach.isNull() | (F.col("start") > reach)).cast("int"))
    marked = marked.withColumn("run", F.sum("fresh").over(by_doc.rowsBetween(W.unboundedPreceding, 0)))
    return marked.groupBy("doc", "run").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def shared_report(docs: DataFrame, stretches: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """For every document how much of it is shared: (doc_id, n_chars, n_stretches, shared_chars, share)."""
    sums = stretches.groupBy(doc_id).agg(F.count(F.lit(1)).alias("n_stretches"), F.sum("span_len").alias("shared_chars"))
    sizes = docs.where(F.col(doc_id).isNotNull()).groupBy(doc_id).agg(F.max(F.length(text)).alias("n_chars"))
    out = sizes.join(sums, doc_id, "left").select(doc_id, F.coalesce("n_chars", F.lit(0)).alias("n_chars"), F.coalesce("n_stretches", F.lit(0)).alias("n_stretches"), F.coalesce("shared_chars", F.lit(0)).alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("n_chars") > 0, F.round(F.col("shared_chars") / F.col("n_chars"), 6)).otherwise(0.0))
