"""Exact substring dedup with a logarithmic family of suffix arrays."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from braid.llm.blobs import pack, schema, shards_of, unpack
from braid.llm.words import mixed
from braid.session import read_table, settle

#: Length of a match in bytes, and of the seeds; every match holds MATCH - SEED + 1 seeds.
MATCH = 100
SEED = 31
SPAN = MATCH - SEED + 1
#: Window starts handled at once, and records per batch of an index.
CHUNK = 1 << 18
BATCH = 1 << 14
BROADCAST_KEYS = 1_000_000
_PLACE = np.uint64((1 << 24) - 1)


# ---- anchors --------------------------------------------------------------------------


def seed_hashes(data: np.ndarray) -> np.ndarray:
    """A hash for each run of SEED bytes, by doubling the hashed length."""
    h = data.astype(np.uint64) + np.uint64(1)
    length, power = 1, 0x9E3779B97F4A7C15
    while 2 * length <= SEED:
        h = h[:-length] * np.uint64(power) + h[length:]
        length, power = 2 * length, 5 * power * power % (1 << 64)
    if length < SEED:
        h = h[: len(h) - (SEED - length)] * np.uint64(power) + h[SEED - length :]
    return mixed(h)


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, place, first, last): the anchors of a text.

    Each window of MATCH bytes belongs to the seed of smallest hash in it, the leftmost one
    of equals; `first` to `last` are the starts of an anchor's windows. Windows of equal
    bytes have equal anchors at equal places.
    """
    found = []
    for begin in range(0, len(data) - MATCH + 1, CHUNK):
        h = seed_hashes(data[begin : begin + CHUNK + MATCH - 1])
        key = (h & ~_PLACE) | np.arange(len(h), dtype=np.uint64)
        low, length = key, 1
        while 2 * length <= SPAN:
            low = np.minimum(low[:-length], low[length:])
            length *= 2
        if length < SPAN:
            low = np.minimum(low[: len(low) - (SPAN - length)], low[SPAN - length :])
        place = (low & _PLACE).astype(np.int64)
        edge = np.flatnonzero(np.concatenate([[True], place[1:] != place[:-1]]))
        at = place[edge]
        found.append((h[at], at + begin, edge + begin, np.append(edge[1:], len(place)) - 1 + begin))
    if not found:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none, none
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


# ---- the index ------------------------------------------------------------------------


def _order(strings: np.ndarray) -> np.ndarray:
    return np.argsort(np.ascontiguousarray(strings).view(f"S{strings.shape[1]}").ravel(), kind="stable")


def _common(strings: np.ndarray) -> np.ndarray:
    """Length of the common beginning of each row and the one before; 0 for the first."""
    out = np.zeros(len(strings), np.int64)
    if len(strings) > 1:
        differ = strings[1:] != strings[:-1]
        first = differ.argmax(1)
        out[1:] = np.where(differ[np.arange(len(first)), first], first, strings.shape[1])
    return out


class SuffixArray:
    """Records sorted by the bytes from their anchor on, and by the bytes before it, backwards."""

    def __init__(self, after: np.ndarray, before: np.ndarray, low: np.ndarray, high: np.ndarray, by_after=None, by_before=None):
        self.after, self.before, self.low, self.high = after, before, low, high
        self.by_after = _order(after) if by_after is None else by_after
        self.by_before = _order(before) if by_before is None else by_before

    def __len__(self) -> int:
        return len(self.low)

    def merged(self, newer: SuffixArray) -> SuffixArray:
        """One array of both; the orders are merged, not sorted anew."""
        after, before = (np.concatenate([getattr(self, k), getattr(newer, k)]) for k in ("after", "before"))
        low, high = (np.concatenate([getattr(self, k), getattr(newer, k)]) for k in ("low", "high"))
        orders = []
        for strings, mine, other in ((after, self.by_after, newer.by_after), (before, self.by_before, newer.by_before)):
            runs = np.concatenate([mine, other + len(self)])
            orders.append(runs[_order(strings[runs])])
        return SuffixArray(after, before, low, high, *orders)

    def window_classes(self) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """For each place of the anchor in the window: that offset, the records that own such a
        window, and a number per record that is the same for equal windows.

        Equal windows agree in enough bytes after the anchor and before it; along a suffix
        array such records are neighbours whose common beginnings are long enough.
        """
        common = [_common(s[o]) for s, o in ((self.after, self.by_after), (self.before, self.by_before))]
        for offset in range(SPAN):
            own = np.flatnonzero((self.low <= offset) & (offset <= self.high))
            if not len(own):
                continue
            number = np.zeros(len(self), np.int64)
            number[self.by_after] = np.cumsum(common[0] < MATCH - offset) << 32
            if offset:
                back = np.empty(len(self), np.int64)
                back[self.by_before] = np.cumsum(common[1] < offset)
                number += back
            yield offset, own, number[own]


class IndexFamily:
    """Suffix arrays of falling size; batches are added in document order.

    A batch gets a suffix array of its own and is scanned, merged, against each level. Two
    levels of about the same size are merged, so that there are few levels, and a record is
    merged into a larger one a logarithmic number of times.
    """

    def __init__(self):
        self.levels: list[SuffixArray] = []

    def add(self, batch: SuffixArray) -> tuple[np.ndarray, np.ndarray]:
        """(record, offset) of the batch's windows that equal a window added before."""
        seen = np.zeros((len(batch), SPAN), bool)
        for offset, own, number in batch.window_classes():
            first = np.unique(number, return_index=True)[1]
            again = np.ones(len(own), bool)
            again[first] = False
            seen[own[again], offset] = True
        for level in self.levels:
            both = level.merged(batch)
            n = len(level)
            for offset, own, number in both.window_classes():
                old = own < n
                if old.any() and not old.all():
                    hit = own[~old][np.isin(number[~old], number[old])] - n
                    seen[hit, offset] = True
        self.levels.append(batch)
        while len(self.levels) > 1 and len(self.levels[-2]) <= 2 * len(self.levels[-1]):
            newer = self.levels.pop()
            self.levels.append(self.levels.pop().merged(newer))
        return np.nonzero(seen)


# ---- the distributed job --------------------------------------------------------------

_SEEN = {"hash": "<u8", "doc": "<i8", "tag": "<u4", "place": "<u4"}
_LAST = (1 << 63) - 1


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """(doc, tag, text): order key of a row and 32 bits of its text's hash, which with the id name it."""
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(
        F.col(doc_id).cast("long").alias("doc_id"),
        F.coalesce(F.col(doc_id).cast("long"), F.lit(_LAST)).alias("doc"),
        F.pmod(F.xxhash64(body), F.lit(1 << 32)).alias("tag"),
        body.alias("text"),
    )


#: Texts copied out of an Arrow batch at once, and records gathered before they are sent.
TEXTS = 500
ANCHORS = 300_000
RECORDS = 50_000


def _slices(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
    return (batch.slice(at, TEXTS) for at in range(0, batch.num_rows, TEXTS))


def _texts(batch: pa.RecordBatch) -> Iterator[tuple[int, int, np.ndarray]]:
    for part in _slices(batch):
        texts = part.column("text").cast(pa.binary()).to_pylist()
        for doc, tag, text in zip(part.column("doc").to_pylist(), part.column("tag").to_pylist(), texts, strict=True):
            yield doc, tag, np.frombuffer(text, np.uint8)


def _all_anchors(rows: DataFrame) -> DataFrame:
    shards = shards_of(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        total = 0

        def gathered() -> pa.RecordBatch:
            h = np.concatenate([p[2] for p in parts])
            sizes = [len(p[2]) for p in parts]
            doc = np.repeat(np.array([p[0] for p in parts], "<i8"), sizes)
            tag = np.repeat(np.array([p[1] for p in parts], "<u4"), sizes)
            place = np.concatenate([p[3] for p in parts]).astype("<u4")
            parts.clear()
            return pack(_shard(h, shards), [h.astype("<u8"), doc, tag, place], list(_SEEN))

        for batch in batches:
            for doc, tag, data in _texts(batch):
                h, place, _, _ = anchors(data)
                if len(h):
                    parts.append((doc, tag, h, place))
                    total += len(h)
                if total >= ANCHORS:
                    yield gathered()
                    total = 0
        if parts:
            yield gathered()

    return rows.mapInArrow(run, schema(list(_SEEN))).repartition(shards, "shard")


def _shard(h: np.ndarray, shards: int) -> np.ndarray:
    return ((h >> np.uint64(32)) % np.uint64(shards)).astype(np.int32)


_PLACE_OF = {"doc": "<i8", "tag": "<u4", "place": "<u4"}
_RUN_OF = {"doc": "<i8", "tag": "<u4", "start": "<u4", "end": "<u4"}


def _by_document(doc: np.ndarray, tag: np.ndarray, columns: list[np.ndarray], fields: dict[str, str], shards: int) -> Iterator[pa.RecordBatch]:
    """Records on their way to their document's shard."""
    number = mixed(doc.astype(np.int64).view(np.uint64) ^ mixed(tag.astype(np.uint64)))
    shard = (number % np.uint64(shards)).astype(np.int32)
    every = [c.astype(k) for c, k in zip([doc, tag, *columns], fields.values(), strict=True)]
    for at in range(0, len(doc), ANCHORS):
        part = slice(at, at + ANCHORS)
        yield pack(shard[part], [c[part] for c in every], list(fields))


def _shared_places(seen: DataFrame) -> DataFrame:
    """(doc, tag, places): the anchors of a document whose hash occurs elsewhere, too; one row each."""
    shards = shards_of(seen)

    def shared(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, _SEEN)
        order = np.argsort(e["hash"], kind="stable")
        h = e["hash"][order]
        if not len(h):
            return
        same = h[1:] == h[:-1]
        twice = np.zeros(len(h), bool)
        twice[1:] |= same
        twice[:-1] |= same
        keep = order[twice]
        yield from _by_document(e["doc"][keep], e["tag"][keep], [e["place"][keep]], _PLACE_OF, shards)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, _PLACE_OF)
        order = np.lexsort((e["place"], e["tag"], e["doc"]))
        yield from _per_document(e["doc"][order], e["tag"][order], [e["place"][order]], ["places"])

    found = seen.mapInArrow(shared, schema(list(_PLACE_OF))).repartition(shards, "shard")
    return found.mapInArrow(gathered, "doc long, tag long, places binary")


def _per_document(doc: np.ndarray, tag: np.ndarray, columns: list[np.ndarray], names: list[str]) -> Iterator[pa.RecordBatch]:
    """One row per document from records in order of documents."""
    if not len(doc):
        return
    edge = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])]))
    ends = np.append(edge[1:], len(doc))
    for at in range(0, len(edge), 50_000):
        pick = slice(at, at + 50_000)
        arrays = [pa.array(doc[edge[pick]]), pa.array(tag[edge[pick]].astype(np.int64))]
        for c in columns:
            arrays.append(pa.array([c[a:b].tobytes() for a, b in zip(edge[pick], ends[pick], strict=True)], pa.binary()))
        yield pa.RecordBatch.from_arrays(arrays, names=["doc", "tag", *names])


_RECORD = {"doc": "<i8", "tag": "<u4", "place": "<u4", "low": "u1", "high": "u1", "again": "u1"}


def _again(cover: np.ndarray, doc, tag, place, low, high) -> np.ndarray:
    """Records whose bytes and windows are those of an earlier record of the same batch.

    All their windows occur before, so their bytes need not travel: of a passage that many
    texts share, a batch sends one copy.
    """
    wide = np.zeros((len(cover), -(-cover.shape[1] // 8) * 8), np.uint8)
    wide[:, : cover.shape[1]] = cover
    number = low.astype(np.uint64) * np.uint64(256) + high.astype(np.uint64)
    for word in wide.view(np.uint64).T:
        number = mixed(number * np.uint64(3) ^ word)
    order = np.lexsort((place, tag, doc, number))
    ranked = number[order]
    new = np.concatenate([[True], ranked[1:] != ranked[:-1]])
    first = order[np.flatnonzero(new)[np.cumsum(new) - 1]]
    same = (low[order] == low[first]) & (high[order] == high[first]) & (wide[order] == wide[first]).all(1)
    out = np.zeros(len(cover), np.uint8)
    out[order] = same & ~new
    return out


def _with_text(rows: DataFrame, found: DataFrame) -> DataFrame:
    """`rows` that have `found` (doc, tag, ...), with it; the keys are broadcast while few."""
    keys = found.select("doc", "tag")
    if keys.count() <= BROADCAST_KEYS:
        rows = rows.join(F.broadcast(keys), ["doc", "tag"], "left_semi")
    return rows.join(found, ["doc", "tag"])


def _records(rows: DataFrame, shared: DataFrame) -> DataFrame:
    """The shared anchors with the bytes that their windows cover, dealt to shards by hash."""
    shards = 2 * shards_of(rows)
    placed = _with_text(rows, shared)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=1)
        parts: list[tuple] = []
        total = 0

        def gathered() -> pa.RecordBatch:
            h = np.concatenate([p[0] for p in parts])
            columns = [np.concatenate([p[i] for p in parts]) for i in range(1, 6)]
            cover = np.concatenate([p[6] for p in parts])
            parts.clear()
            columns.append(_again(cover, *columns))
            shard = _shard(h, shards)
            names = list(_RECORD)
            rest = pack(shard, [c.astype(k) for c, k in zip(columns, _RECORD.values(), strict=True)], names)
            order = np.argsort(shard, kind="stable")
            ends = np.append(np.flatnonzero(shard[order][1:] != shard[order][:-1]) + 1, len(shard))
            blocks, at = [], 0
            for end in ends if len(shard) else []:
                here = order[at:end]
                blocks.append(press.compress(cover[here[columns[-1][here] == 0]].tobytes()))
                at = end
            return pa.RecordBatch.from_arrays([*rest.columns, pa.array(blocks, pa.binary())], names=["shard", *names, "bytes"])

        done: set[tuple[int, int]] = set()
        for batch in batches:
            for (doc, tag, data), places in zip(_texts(batch), batch.column("places").to_pylist(), strict=True):
                if (doc, tag) in done:
                    continue
                done.add((doc, tag))
                h, place, first, last = anchors(data)
                wanted = np.isin(place, np.frombuffer(places, "<u4"))
                h, place, first, last = h[wanted], place[wanted], first[wanted], last[wanted]
                # MATCH bytes from the anchor on and SPAN - 1 before it; what no window of
                # the anchor covers is zero and never looked at.
                wide = np.concatenate([np.zeros(SPAN - 1, np.uint8), data, np.zeros(MATCH, np.uint8)])
                cover = np.lib.stride_tricks.sliding_window_view(wide, SPAN - 1 + MATCH)[place].copy()
                column = np.arange(SPAN - 1 + MATCH)
                outside = (column < (SPAN - 1 - (place - first))[:, None]) | (column >= (SPAN - 1 + last + MATCH - place)[:, None])
                cover[outside] = 0
                n = len(place)
                parts.append((h, np.full(n, doc), np.full(n, tag), place, place - last, place - first, cover))
                total += n
                if total >= RECORDS:
                    yield gathered()
                    total = 0
        if parts:
            yield gathered()

    return placed.mapInArrow(run, schema([*_RECORD, "bytes"])).repartition(shards, "shard")


def _seed_numbers(cover: np.ndarray) -> np.ndarray:
    """A number per record that is the same for equal seeds."""
    words = np.ascontiguousarray(cover[:, SPAN - 1 : SPAN + 23]).view(np.uint64)
    return mixed(words[:, 0] ^ mixed(words[:, 1] + np.uint64(1)) ^ mixed(words[:, 2] + np.uint64(2)))


def _joined(doc, tag, start, end) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs (doc, tag, start, end) in order, with overlapping and touching ones of a document joined."""
    order = np.lexsort((start, tag, doc))
    doc, tag, start, end = doc[order], tag[order], start[order].astype(np.int64), end[order].astype(np.int64)
    if not len(doc):
        return doc, tag, start, end
    # The numbers of the documents keep their ends apart.
    other = np.concatenate([[True], (doc[1:] != doc[:-1]) | (tag[1:] != tag[:-1])])
    far = np.cumsum(other) << 33
    reach = np.maximum.accumulate(far + end)
    first = np.flatnonzero(np.concatenate([[True], (far + start)[1:] > reach[:-1]]))
    last = np.append(first[1:], len(doc)) - 1
    return doc[first], tag[first], start[first], reach[last] - far[last]


def _repeats(records: DataFrame) -> DataFrame:
    """(doc, tag, starts, ends): the runs of bytes of windows that occur before, one row per document."""
    shards = shards_of(records)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept: dict[str, list] = {k: [] for k in _RECORD}
        rows: list[np.ndarray] = []
        press = zstandard.ZstdDecompressor()
        for batch in batches:
            for k, kind in _RECORD.items():
                kept[k] += [np.frombuffer(x, kind) for x in batch.column(k).to_pylist()]
            rows += [np.frombuffer(press.decompress(x), np.uint8).reshape(-1, SPAN - 1 + MATCH) for x in batch.column("bytes").to_pylist()]
        if not rows:
            return
        e = {k: np.concatenate(v) for k, v in kept.items()}
        # Where a record's bytes are, and the records by document order, without a second copy.
        fresh = np.flatnonzero(e["again"] == 0)
        part, line = np.zeros(len(e["doc"]), np.int64), np.zeros(len(e["doc"]), np.int64)
        part[fresh] = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        line[fresh] = np.concatenate([np.arange(len(r)) for r in rows])
        order = np.lexsort((1 - e["again"], e["low"], e["place"], e["tag"], e["doc"]))
        # Equal rows are one document, wherever they were read.
        twin = np.ones(len(order), bool)
        twin[0] = False
        for k in ("doc", "tag", "place", "low"):
            twin[1:] &= e[k][order][1:] == e[k][order][:-1]
        order = order[~twin]
        known = order[e["again"][order] > 0]
        order = order[e["again"][order] == 0]
        # Equal seeds meet in one of several smaller families, which hold one after the other.
        seeds = np.zeros(len(e["doc"]), np.uint64)
        seeds[fresh] = np.concatenate([_seed_numbers(r) for r in rows])
        seeds = seeds[order]
        several = max(1, -(-len(order) // BATCH))
        group = (seeds % np.uint64(several)).astype(np.int64)
        order = order[np.argsort(group, kind="stable")]
        ends = np.cumsum(np.bincount(group, minlength=several))
        hits: list[tuple[np.ndarray, np.ndarray]] = []
        for begin, end in zip(np.append(0, ends[:-1]), ends, strict=True):
            family = IndexFamily()
            for at in range(begin, end, BATCH):
                pick = order[at : min(at + BATCH, end)]
                cover = np.empty((len(pick), SPAN - 1 + MATCH), np.uint8)
                for p in np.unique(part[pick]):
                    here = part[pick] == p
                    cover[here] = rows[p][line[pick[here]]]
                before = np.ascontiguousarray(cover[:, SPAN - 2 :: -1])
                low, high = (e[k][pick].astype(np.int64) for k in ("low", "high"))
                record, offset = family.add(SuffixArray(np.ascontiguousarray(cover[:, SPAN - 1 :]), before, low, high))
                hits.append((pick[record], offset))
        empty = [np.zeros(0, np.int64)]
        record, offset = (np.concatenate([*empty, *[h[i] for h in hits]]).astype(np.int64) for i in (0, 1))
        place = e["place"].astype(np.int64)
        start = np.concatenate([place[record] - offset, place[known] - e["high"][known]])
        end = np.concatenate([place[record] - offset, place[known] - e["low"][known]]) + MATCH
        record = np.concatenate([record, known])
        doc, tag, start, end = _joined(e["doc"][record], e["tag"][record], start, end)
        yield from _by_document(doc, tag, [start, end], _RUN_OF, shards)

    def gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = unpack(batches, _RUN_OF)
        doc, tag, start, end = _joined(*(e[k] for k in _RUN_OF))
        yield from _per_document(doc, tag, [start.astype("<u4"), end.astype("<u4")], ["starts", "ends"])

    found = records.mapInArrow(run, schema(list(_RUN_OF))).repartition(shards, "shard")
    return found.mapInArrow(gathered, "doc long, tag long, starts binary, ends binary")


_RESULT = "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary, starts array<long>, ends array<long>, kept_sha256 string"


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Texts without the bytes of strings of MATCH bytes that also start earlier.

    One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept (the remaining bytes),
    starts and ends of the maximal removed runs, kept_sha256. Earlier means in a document of
    smaller doc_id, or at a smaller start; a null doc_id is larger than any. Rows of equal id
    and different texts are documents in order of a hash of the text; rows of equal id and
    text are one document, whose result each of them gets. Null texts count as empty. Matches
    are judged on the input, also within one text, and never cross texts.

    Each window of MATCH bytes belongs to one seed in it, its anchor, which equal windows have
    at equal places. Anchors meet by hash; those that occur more than once are sent, with the
    bytes their windows cover, to the shard of their hash, which adds them in document order
    to an IndexFamily. Texts that hold a shared anchor or a repeat are shuffled once for each
    of the two steps, all others never.
    """
    rows = _rows(docs, doc_id, text)
    shared = settle(_shared_places(_all_anchors(rows)), "anchors")
    repeats = settle(_repeats(_records(rows, shared)), "repeats")
    runs = repeats.select("doc", "tag", F.col("starts").alias("s"), F.col("ends").alias("e"))
    keys = repeats.select("doc", "tag")
    if keys.count() <= BROADCAST_KEYS:
        few = F.broadcast(keys)
        with_runs = rows.join(few, ["doc", "tag"], "left_semi").join(runs, ["doc", "tag"])
        none = F.lit(None).cast("binary")
        without = rows.join(few, ["doc", "tag"], "left_anti").withColumns({"s": none, "e": none})
        together = with_runs.unionByName(without)
    else:
        together = rows.join(runs, ["doc", "tag"], "left")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.string()]
        names = [x.split()[0] for x in _RESULT.split(", ")]
        for batch in (part for whole in batches for part in _slices(whole)):
            out = []
            ids, texts = batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()).to_pylist()
            for doc, data, s, e in zip(ids, texts, batch.column("s").to_pylist(), batch.column("e").to_pylist(), strict=True):
                starts, ends = (np.frombuffer(x or b"", "<u4").tolist() for x in (s, e))
                edges = [0, *[x for run in zip(starts, ends, strict=True) for x in run], len(data)]
                kept = b"".join(data[a:b] for a, b in zip(edges[::2], edges[1::2], strict=True))
                out.append((doc, len(data), len(data) - len(kept), len(starts), kept, starts, ends, hashlib.sha256(kept).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in out], k) for i, k in enumerate(kinds)], names=names)

    return together.select("doc_id", "text", "s", "e").mapInArrow(cut, _RESULT)


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = deduplicated(read_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
