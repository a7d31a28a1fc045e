"""Long exact spans shared between records, by difference-cover anchors.

A difference cover D of the period v holds, for every d, two members whose difference is d modulo v.
So of two places where the same run of `least` code points stands, some offset below v puts both at
cover positions, and the windows of least - v + 1 code points there are equal. Hashing the windows at
cover positions only finds every such run from |D| / v of the positions.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from versemill.plans.lineage import cut

LEAST = 100
# Perfect difference sets, by period.
COVERS = {
    3: (0, 1),
    7: (0, 1, 3),
    13: (0, 1, 3, 9),
    21: (0, 1, 4, 14, 16),
    31: (1, 5, 11, 24, 25, 27),
    57: (0, 1, 3, 13, 32, 36, 43, 52),
}
#: Records that share one anchor and are paired directly; with more of them the anchor is hot.
PAIRED = 128
CHUNK, PER_BUCKET = 1_000_000, 100_000
#: Buckets over which the records of anchors that are hot within a task are spread, for each plain one.
SALTS = 4096
_BASE = np.uint64(0x9E3779B97F4A7C15)
_powers = _inverses = np.ones(1, np.uint64)


def cover(least: int) -> tuple[int, np.ndarray, int]:
    """(period, its cover as a mask, window) for runs of `least` code points."""
    period = max((v for v in COVERS if 3 * v <= least + 2), default=1)
    mask = np.zeros(period, bool)
    mask[list(COVERS.get(period, (0,)))] = True
    return period, mask, least - period + 1


def _codes(texts: list[str]) -> np.ndarray:
    return np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)


def window_hashes(codes: np.ndarray, at: np.ndarray, window: int) -> np.ndarray:
    """Hashes of the windows that begin at `at`, equal for equal windows wherever they stand."""
    global _powers, _inverses
    if len(_powers) < len(codes) + 1:
        one = [np.uint64(1)]
        _powers = np.concatenate([one, np.cumprod(np.full(len(codes) + CHUNK, _BASE))])
        _inverses = np.concatenate([one, np.cumprod(np.full(len(codes) + CHUNK, np.uint64(pow(int(_BASE), -1, 2**64))))])
    c = codes.astype(np.uint64)
    c = (c ^ (c << np.uint64(23))) * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(0x94D049BB133111EB)
    sums = np.concatenate([[np.uint64(0)], np.cumsum(c * _powers[: len(c)])])
    return _mix((sums[at + window] - sums[at]) * _inverses[at])


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def anchors(texts: list[str], least: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(text, place, hash) of every anchor of the texts."""
    period, mask, window = cover(least)
    sizes = np.array([len(t) for t in texts], np.int64)
    starts = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    place = np.arange(int(sizes.sum())) - starts[owner]
    at = np.flatnonzero(mask[place % period] & (place <= sizes[owner] - window))
    return owner[at], place[at], window_hashes(_codes(texts), at, window)


def _chunks(ids: np.ndarray, texts: list[str]) -> Iterator[tuple[np.ndarray, list[str]]]:
    begin, size = 0, 0
    for k, t in enumerate(texts):
        size += len(t)
        if size >= CHUNK:
            yield ids[begin : k + 1], texts[begin : k + 1]
            begin, size = k + 1, 0
    if begin < len(texts):
        yield ids[begin:], texts[begin:]


def _blobs(docs: DataFrame, least: int, buckets: int, most: int = 4 * CHUNK) -> DataFrame:
    """Anchors packed by bucket: (bucket, hot, low, rec), the last two arrays in bytes.

    Of an anchor that is hot within a stretch of a task, one record goes to the bucket, flagged; the
    records themselves go to one of SALTS buckets of their own, where they are only unpacked.
    """

    def pack(bucket, low, rec, hot: bool) -> pa.RecordBatch:
        cuts = np.flatnonzero(np.diff(bucket)) + 1
        begin, end = np.concatenate([[0], cuts]), np.concatenate([cuts, [len(bucket)]])
        lows, recs = low.tobytes(), rec.tobytes()
        return pa.RecordBatch.from_arrays(
            [
                pa.array(bucket[begin].astype(np.int64)),
                pa.array(np.full(len(begin), hot)),
                pa.array([lows[4 * s : 4 * e] for s, e in zip(begin.tolist(), end.tolist())], pa.binary()),
                pa.array([recs[8 * s : 8 * e] for s, e in zip(begin.tolist(), end.tolist())], pa.binary()),
            ],
            ["bucket", "hot", "low", "rec"],
        )

    def flush(held: list) -> Iterator[pa.RecordBatch]:
        h = np.concatenate([x for x, _ in held])
        rec = np.concatenate([x for _, x in held])
        h = (h % np.uint64(buckets)) << np.uint64(32) | (h >> np.uint64(32))
        order = np.lexsort((rec, h))
        h, rec = h[order], rec[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (rec[1:] != rec[:-1])
        h, rec = h[new], rec[new]
        first = np.ones(len(h), bool)
        first[1:] = h[1:] != h[:-1]
        group = np.cumsum(first) - 1
        hot = (np.bincount(group) > PAIRED)[group]
        bucket, low = (h >> np.uint64(32)).astype(np.int64), (h & np.uint64(0xFFFFFFFF)).astype(np.uint32)
        salt = int(h[0] ^ rec[:1].view(np.uint64)[0]) % SALTS
        for x, flag, away in ((~hot, False, 0), (hot & first, True, 0), (hot, True, (1 + salt) * buckets)):
            if x.any():
                yield pack(bucket[x] + away, low[x], rec[x], flag)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            for ids, texts in _chunks(batch.column(0).to_numpy(), batch.column(1).to_pylist()):
                owner, _, h = anchors(texts, least)
                held.append((h, ids[owner]))
                size += len(h)
                if size > most:
                    yield from flush(held)
                    held, size = [], 0
        if size:
            yield from flush(held)

    return docs.mapInArrow(run, "bucket long, hot boolean, low binary, rec binary")


def _meet(blobs: DataFrame, buckets: int, paired: int = PAIRED, most: int = 4 * CHUNK) -> DataFrame:
    """(a, b, h): pairs of records with an equal anchor, h null; or a record with a hot anchor h, b null.

    Anchors of more than `paired` records are hot; with `paired` 1 all anchors of several records are. The
    pieces of a bucket are folded on the way, so that it never holds more than `paired` records of an anchor and
    the last pieces.
    """

    def grouped(low, rec, flag):
        order = np.argsort(low, kind="stable")
        low, rec, flag = low[order], rec[order], flag[order]
        first = np.ones(len(low), bool)
        first[1:] = low[1:] != low[:-1]
        group = np.cumsum(first) - 1
        sizes = np.bincount(group)
        hot = ((sizes > paired) | (np.bincount(group, flag) > 0))[group]
        return low, rec, first, group, sizes, hot

    def arrays(pieces: list):
        low = np.concatenate([np.frombuffer(p[1], np.uint32) for p in pieces])
        rec = np.concatenate([np.frombuffer(p[2], np.int64) for p in pieces])
        return low, rec, np.repeat([p[0] for p in pieces], [len(p[1]) // 4 for p in pieces])

    def fold(number: int, pieces: list) -> tuple[list, list]:
        """(rows given out, pieces left): the records of hot anchors go, but for one that is flagged."""
        low, rec, first, _, _, hot = grouped(*arrays(pieces))
        out = [rows(rec[hot], None, (np.int64(number) << 32) + low[hot].astype(np.int64))] if hot.any() else []
        one = hot & first
        return out, [[flag, low[x].tobytes(), rec[x].tobytes()] for flag, x in ((False, ~hot), (True, one)) if x.any()]

    def bucket(number: int, pieces: list) -> Iterator[pa.RecordBatch]:
        low, rec, _, group, sizes, hot = grouped(*arrays(pieces))
        if hot.any():
            yield rows(rec[hot], None, (np.int64(number) << 32) + low[hot].astype(np.int64))
        keep = ~hot & (sizes > 1)[group]
        rec, group = rec[keep], group[keep]
        for lag in range(1, len(rec)):
            same = group[lag:] == group[:-lag]
            if not same.any():
                break
            a, b = rec[:-lag][same], rec[lag:][same]
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)]), axis=1)
            pairs = pairs[:, pairs[0] != pairs[1]]
            if pairs.size:
                yield rows(pairs[0], pairs[1], None)

    def rows(a, b, h) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if h is None else pa.array(h)], ["a", "b", "h"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, pieces, size = None, [], 0
        for batch in batches:
            for number, *piece in zip(*[c.to_pylist() for c in batch.columns]):
                if number >= buckets:
                    low, rec, _ = arrays([piece])
                    yield rows(rec, None, (np.int64(number % buckets) << 32) + low.astype(np.int64))
                    continue
                if number != at and pieces:
                    yield from bucket(at, pieces)
                    pieces, size = [], 0
                at = number
                pieces.append(piece)
                size += len(piece[1]) // 4
                if size > most:
                    out, pieces = fold(at, pieces)
                    yield from out
                    size = 0
        if pieces:
            yield from bucket(at, pieces)

    return blobs.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(run, "a long, b long, h long")


def _near(place: np.ndarray, size: int, least: int) -> np.ndarray:
    """The begins of all runs of `least` code points that contain the window of one of the anchors at `place`."""
    _, _, window = cover(least)
    begin = np.unique((place[:, None] - np.arange(least - window + 1)[None, :]).ravel())
    return begin[(begin >= 0) & (begin <= size - least)]


def _runs_at(docs: DataFrame, hot: DataFrame, least: int, buckets: int) -> DataFrame:
    """(run, rec, begin): hashes of the runs of `least` code points that contain a hot anchor (a, h) of the record."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rec, text, wanted in zip(*[c.to_pylist() for c in batch.columns]):
                _, place, h = anchors([text], least)
                h = ((h % np.uint64(buckets)) << np.uint64(32) | (h >> np.uint64(32))).astype(np.int64)
                begin = _near(place[np.isin(h, np.array(wanted, np.int64))], len(text), least)
                if begin.size:
                    found = window_hashes(_codes([text]), begin, least).view(np.int64)
                    yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.full(len(found), rec)), pa.array(begin)], ["run", "rec", "begin"])

    wanted = hot.groupBy(F.col("a").alias("rec")).agg(F.collect_set("h").alias("wanted"))
    return docs.join(wanted, "rec").select("rec", "text", "wanted").mapInArrow(run, "run long, rec long, begin long")


def _stretches(begin: np.ndarray, least: int) -> list[tuple[int, int]]:
    """(begin, size) of the passages that consecutive begins of runs make up."""
    cuts = np.flatnonzero(np.diff(begin) != 1)
    first, last = begin[np.concatenate([[0], cuts + 1])], begin[np.concatenate([cuts, [len(begin) - 1]])]
    return list(zip(first.tolist(), (last - first + least).tolist()))


def common_passages(a: str, b: str, least: int) -> tuple[list[tuple[int, int]], list[tuple[int, int]]]:
    """(begin, size) of the passages of a held in b, and of those of b held in a.

    A passage is a longest stretch all of whose runs of `least` code points stand in the other text. The
    work is linear in the texts, periodic ones too: places are not paired.
    """
    owner, place, h = anchors([a, b], least)
    both = np.intersect1d(h[owner == 0], h[owner == 1])
    known = np.isin(h, both)
    x, y = (_near(place[known & (owner == k)], len(t), least) for k, t in ((0, a), (1, b)))
    if not x.size or not y.size:
        return [], []
    hx, hy = window_hashes(_codes([a]), x, least), window_hashes(_codes([b]), y, least)
    order = np.argsort(hy, kind="stable")
    at = np.minimum(np.searchsorted(hy[order], hx), len(hy) - 1)
    hit = hy[order][at] == hx
    x, q, hx = x[hit], y[order][at][hit], hx[hit]
    if not x.size:
        return [], []
    # exact comparison: stretches in which both places advance together, as a whole
    cuts = np.flatnonzero((np.diff(x) != 1) | (np.diff(q) != 1)) + 1
    ok = np.ones(len(x), bool)
    for s, e in zip([0, *cuts.tolist()], [*cuts.tolist(), len(x)]):
        p, r, n = int(x[s]), int(q[s]), e - s - 1 + least
        if a[p : p + n] != b[r : r + n]:
            ok[s:e] = [a[p + k : p + k + least] == b[r + k : r + k + least] for k in range(e - s)]
    x, hx = x[ok], hx[ok]
    y = y[np.isin(hy, hx)]
    return (_stretches(x, least), _stretches(y, least)) if x.size else ([], [])


def _extend(pairs: DataFrame, docs: DataFrame, least: int) -> DataFrame:
    """(rec, other, begin, size): the passages of each text of a pair that the other holds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for a, b, x, y in zip(*[c.to_pylist() for c in batch.columns]):
                of_a, of_b = common_passages(x, y, least)
                out += [(a, b, *p) for p in of_a] + [(b, a, *p) for p in of_b]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["rec", "other", "begin", "size"])

    ids = cut(pairs.select(F.explode(F.array("a", "b")).alias("rec")).distinct(), "involved")
    texts = docs.join(ids, "rec", "left_semi")
    left, right = (texts.select(F.col("rec").alias(k), F.col("text").alias(t)) for k, t in (("a", "x"), ("b", "y")))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "rec long, other long, begin long, size long")


def _classes(df: DataFrame, key: str, text: str, least: int) -> tuple[DataFrame, DataFrame, int]:
    """(members(rec, rep, n), docs(rec, text), buckets): records of one text are a class, named by its least
    key, whose text stands in docs. Null texts and those shorter than `least` take no part."""
    docs = df.where(F.col(key).isNotNull()).select(F.col(key).cast("long").alias("rec"), F.col(text).cast("string").alias("text")).where(F.length("text") >= least)
    each = cut(docs.select("rec", F.unhex(F.sha2("text", 256)).alias("sha"), F.length("text").alias("n")), "digests")
    first = each.groupBy("sha").agg(F.min("rec").alias("rep"), F.count("*").alias("held")).where("held > 1")
    copies = cut(each.join(first, "sha").select("rec", "rep").distinct(), "copies")
    members = each.join(copies, "rec", "left").select("rec", F.coalesce("rep", "rec").alias("rep"), "n").distinct()
    docs = docs.join(copies.where("rec <> rep").select("rec"), "rec", "left_anti")
    chars = each.agg(F.sum("n")).first()[0] or 0
    period, mask, _ = cover(least)
    return members, docs, max(64, int(chars * mask.sum() / period / PER_BUCKET))


def shared_passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> tuple[DataFrame, DataFrame]:
    """(members(rec, rep, n), passages(rec, other, begin, size)).

    Records of one text are a class, named by its least key; passages are the longest stretches of a
    class's text all of whose runs of `least` code points stand in the text of another class. Null texts and those
    shorter than `least` take no part. Anchors that more than PAIRED records hold are refined to the hashes
    of whole runs, so a standing phrase below the length gives no pairs however common it is.
    """
    members, docs, buckets = _classes(df, key, text, least)
    met = cut(_meet(_blobs(docs, least, buckets), buckets).distinct(), "met")
    pairs, hot = met.where("b IS NOT NULL").select("a", "b"), met.where("b IS NULL").select("a", "h")
    if not hot.isEmpty():
        runs = cut(_runs_at(docs, hot, least, buckets).select("run", "rec").distinct(), "runs")
        several = runs.groupBy("run").count().where("count > 1").select("run")
        runs = runs.join(several, "run", "left_semi")
        refined = runs.select("run", F.col("rec").alias("a")).join(runs.select("run", F.col("rec").alias("b")), "run").where("a < b").select("a", "b")
        pairs = cut(pairs.union(refined).distinct(), "pairs")
    return members, cut(_extend(pairs, docs, least), "passages")


def passages(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, other, begin, size): the passages of the representative of each class of equal texts that the
    representative of another class holds, in code points from 0; shared_amount() names the classes."""
    return shared_passages(df, key, text, least)[1].select(F.col("rec").alias(key), "other", "begin", "size")


def span_pairs(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(doc_a, doc_b), doc_a < doc_b: records whose texts have a run of `least` code points in common."""
    members, held = shared_passages(df, key, text, least)
    links = held.where("rec < other").select(F.col("rec").alias("a"), F.col("other").alias("b")).distinct()
    left, right = (members.select(F.col("rep").alias(k), F.col("rec").alias(x)) for k, x in (("a", "x"), ("b", "y")))
    near = links.join(left, "a").join(right, "b").select("x", "y")
    several = members.where("rec <> rep").select("rep").distinct()
    copied = members.join(several, "rep", "left_semi")
    copies = copied.select("rep", F.col("rec").alias("x")).join(copied.select("rep", F.col("rec").alias("y")), "rep").where("x < y").select("x", "y")
    return near.union(copies).where("x <> y").select(F.least("x", "y").alias("doc_a"), F.greatest("x", "y").alias("doc_b")).distinct()


def shared_amount(df: DataFrame, key: str = "doc_id", text: str = "text", least: int = LEAST) -> DataFrame:
    """(key, class_no, n_chars, shared_chars) of every record: the least key with the same text, and the code points
    of the text that lie in a run of at least `least` held elsewhere too. Null texts have 0 of both and, as those
    shorter than `least`, no class (null); copies share their whole text.

    Records are never paired: anchors that several records hold lead to their runs, and runs that
    several records hold to the places that they cover.
    """
    members, docs, buckets = _classes(df, key, text, least)
    hot = _meet(_blobs(docs, least, buckets), buckets, paired=1).where("b IS NULL").select("a", "h").distinct()
    runs = cut(_runs_at(docs, hot, least, buckets), "runs")
    several = runs.groupBy("run").agg(F.min("rec").alias("x"), F.max("rec").alias("y")).where("x <> y").select("run")
    places = runs.join(several, "run", "left_semi").select("rec", "begin").distinct()
    gain = F.least(F.lit(least).cast("long"), F.coalesce(F.col("begin") - F.lag("begin").over(Window.partitionBy("rec").orderBy("begin")), F.lit(least)))
    covered = places.select(F.col("rec").alias("rep"), gain.alias("gain")).groupBy("rep").agg(F.sum("gain").alias("shared"))
    several = members.where("rec <> rep").select("rep").distinct().withColumn("copied", F.lit(True))
    of = members.join(covered, "rep", "left").join(several, "rep", "left").select(F.col("rec").alias(key), "rep", F.when(F.col("copied"), F.col("n").cast("long")).otherwise(F.col("shared")).alias("shared"))
    none = F.lit(0).cast("long")
    rows = df.where(F.col(key).isNotNull()).select(key, F.coalesce(F.length(text).cast("long"), none).alias("n_chars"))
    return rows.join(of, key, "left").select(key, F.col("rep").alias("class_no"), "n_chars", F.coalesce("shared", none).alias("shared_chars"))
