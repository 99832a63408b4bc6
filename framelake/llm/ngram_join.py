"""Exact Jaccard join of documents over word n-grams, as components.

Documents are rows and n-grams columns of an incidence matrix; the product with
its transpose holds the overlap counts.  Only blocks that can hold a link are
multiplied, and within a block pairs are given up as soon as what is still to
come cannot lift them over the bound that their sizes set.

1. Documents with the same set are one row (a 64-bit signature stands for it).
2. How common a column is, an array of counters tells, summed over all
   documents; every row is ordered by it, rare columns first, and those that
   stand once are not dealt.  Columns far above
   the mean are called common.  Any fixed order is right; a good one keeps rows
   apart that share only what many share.
3. Two rows that link share one of their first ``n - ceil(t n) + 1`` columns in
   any fixed order (prefix bound), so rows are dealt by those columns.  A column
   with few rows adds one to the overlap of each pair of them; pairs whose sum
   stays under what their sizes demand of the prefixes are dropped.  All rows of
   any other column are tied to its smallest one: a star, not all pairs.  Rows
   of a common column are first tied within salted shares, then share by share.
4. Rows tied together, directly or not, are a candidate group, which holds
   every link of its rows.  Groups are cut into blocks of bounded bytes.  Rows of
   a large group are first multiplied with one of them, the centre; those that
   link with it are settled, as they are one component already.  What is left is
   every pair with a row that is not settled: those pairs of blocks are
   multiplied, and each returns links that span its components.
5. Components of those links, with all copies, are the result.

Cases: null or empty text has an empty set and its own component; fewer words
than ``n`` give one n-gram of them all; repeated rows share a component, and a
repeated id counts as the rows it has; rows without id link like any others, but
name no component: its id is null where none of its rows has one; an empty table
gives no rows; other columns are not looked at.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import text as X
from .graph import components, frequent, joined, membership
from .storage import dropped, saved

#: Counters at least and at most, bytes of text for each, and how many travel in one row.
COUNTERS, BYTES_A_COUNTER, COUNTER_ROW = (1 << 16, 1 << 25), 24, 1 << 14
#: Rank of a column whose counter is far above the mean, and of one that stands once in all documents.
COMMON, ALONE = 255, 0
#: Input partitions that one task counts at most.
COUNTED = 16
#: Shares into which the rows of a common column are dealt.
SALTS = 32
#: Rows of a column whose pairs are counted; of more rows, all are tied.
FEW = 12
#: N-grams of a block at least, and blocks of a group at most, until blocks get too large (8 bytes each).
BLOCK, MOST_BLOCKS, LARGEST = 1 << 18, 12, 1 << 20
#: Blocks from which on a group's centre is looked at first.
SETTLE = 4
#: Rows and columns multiplied at a time.
TILE, COLUMNS = 1024, 2048


def sets(w: X.Words, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(columns, text, bounds) of the distinct n-grams of every text, rising within a text."""
    h, who, _ = X.grams_by_text(w, n, whole_if_shorter=True)
    order = np.lexsort((h, who))
    h, who = h[order], who[order]
    if len(h):
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (who[1:] != who[:-1])])
        h, who = h[keep], who[keep]
    return h, who, np.searchsorted(who, np.arange(len(w.first)))


def _signatures(h: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.zeros(len(h) + 1, np.uint64)
    np.cumsum(X.mix(h ^ np.uint64(0xA5A5A5A5A5A5A5A5)), dtype=np.uint64, out=total[1:])
    return X.mix(total[bounds[1:]] - total[bounds[:-1]] + np.diff(bounds).astype(np.uint64)).view(np.int64)


def _read(column: pa.Array) -> Iterator[tuple[int, int, X.Words]]:
    for lo, hi, data, bounds in X.slices(column):
        yield lo, hi, X.words(data, bounds, X.SPACED, lower=True)


def _packed(counts: np.ndarray) -> bytes:
    """Bytes of a run of counters, most of them 0 and most others 1: which are used, and what those have over one."""
    used = counts > 0
    return zlib.compress(np.packbits(used).tobytes() + (counts[used] - 1).tobytes(), 1)


def _unpacked(data: bytes) -> np.ndarray:
    raw = np.frombuffer(zlib.decompress(data), np.uint8)
    out = np.unpackbits(raw[: COUNTER_ROW // 8])
    out[out > 0] += raw[COUNTER_ROW // 8 :]
    return out


def column_ranks(docs: DataFrame, n: int) -> np.ndarray:
    """Rank of every counter: 128 at the mean, 16 a standard deviation, COMMON from eight of them on.

    A task's counters stop at 255; the rank would be COMMON long before.  Tasks
    are as many as the cluster runs at a time, or more where they would have too
    much to count, as each sends a set of counters.
    """
    size = docs.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    counters = COUNTERS[0]
    while counters < min(size / BYTES_A_COUNTER, COUNTERS[1]):
        counters *= 2

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = np.zeros(counters, np.uint8)
        for b in batches:
            for _, _, w in _read(b.column(0)):
                h, _, _ = X.grams_by_text(w, n, whole_if_shorter=True)
                at, c = np.unique(h & np.uint64(counters - 1), return_counts=True)
                at = at.astype(np.int64)
                mine[at] = np.minimum(mine[at] + c, 255)
        parts = [_packed(mine[lo : lo + COUNTER_ROW]) for lo in range(0, counters, COUNTER_ROW)]
        yield pa.RecordBatch.from_arrays([pa.array(range(len(parts)), pa.int32()), pa.array(parts, pa.binary())], names=["part", "counts"])

    def add(table: pa.Table) -> pa.Table:
        total = np.zeros(COUNTER_ROW)
        for x in table["counts"]:
            total += _unpacked(x.as_py())
        mean = total.mean()
        rank = np.clip(np.round((total - mean) / max(1.0, np.sqrt(mean)) * 16) + 128, 1, COMMON).astype(np.uint8)
        rank[total <= 1] = ALONE
        return pa.table({"part": table["part"][:1], "counts": pa.array([zlib.compress(rank.tobytes(), 1)], pa.binary())})

    schema = "part int, counts binary"
    texts = docs.select("text")
    tasks = max(2 * docs.sparkSession.sparkContext.defaultParallelism, -(-texts.rdd.getNumPartitions() // COUNTED))
    got = texts.coalesce(tasks).transform(X.streamed(count, schema)).groupBy("part").applyInArrow(add, schema).toArrow()
    out = np.full(counters, 128, np.uint8)
    for part, rank in zip(got["part"].to_pylist(), got["counts"].to_pylist(), strict=True):
        out[part * COUNTER_ROW : (part + 1) * COUNTER_ROW] = np.frombuffer(zlib.decompress(rank), np.uint8)
    return out


def _rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, n_shingles and signature of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for lo, hi, w in _read(b.column(1)):
                h, _, bounds = sets(w, n)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(np.diff(bounds)), pa.array(_signatures(h, bounds))], names=["doc_id", "n", "sig"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(X.streamed(run, "doc_id bigint, n bigint, sig bigint"))


def _prefixes(docs: DataFrame, n: int, percent: int) -> DataFrame:
    """The first columns of every row, common ones last: column, salt (0: not common), sig."""
    shared = docs.sparkSession.sparkContext.broadcast(column_ranks(docs, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = shared.value
        for b in batches:
            for _, _, w in _read(b.column(0)):
                h, who, bounds = sets(w, n)
                sig = _signatures(h, bounds)
                first = np.zeros(len(sig), bool)  # copies in one slice speak once
                first[np.unique(sig, return_index=True)[1]] = True
                keep = first[who]
                h, who = h[keep], who[keep]
                rank = ranks[(h & np.uint64(len(ranks) - 1)).astype(np.int64)]
                order = np.lexsort((h, rank, who))
                h, who, last = h[order], who[order], rank[order] == COMMON
                size = np.bincount(who, minlength=len(sig))
                place = np.arange(len(h)) - (np.cumsum(size) - size)[who]
                # a column that stands once is no other row's
                keep = (place < (size - -(-size * percent // 100) + 1)[who]) & (rank[order] != ALONE)
                # 48 bits of a column are enough to deal rows by: two columns that fall together only tie more rows
                h, last, s = h[keep] & np.uint64((1 << 48) - 1), last[keep], sig[who[keep]]
                yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(np.where(last, 1 + (s.view(np.uint64) % np.uint64(SALTS)).astype(np.int64), 0).astype(np.int32)), pa.array(s)], names=["h", "salt", "sig"])

    return docs.select("text").transform(X.streamed(run, "h bigint, salt int, sig bigint"))


def _within_columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (h, salt, sig), sorted: pairs of a column of few rows (kind 0: a, b), ties of others (1: sig, lowest; 2, of common ones: lowest, h) and how often a row is tied (3: sig)."""

    def columns(h: np.ndarray, salt: np.ndarray, sig: np.ndarray) -> Iterator[pa.RecordBatch]:
        keep = np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1]) | (sig[1:] != sig[:-1])])
        h, salt, sig = h[keep], salt[keep], sig[keep]
        first = np.flatnonzero(np.concatenate([[True], (h[1:] != h[:-1]) | (salt[1:] != salt[:-1])]))
        size = np.diff(np.append(first, len(h)))
        few = (salt[first] == 0) & (size <= FEW)
        out = []
        for k in range(2, FEW + 1):
            at = first[few & (size == k)]
            for i in range(k):
                for j in range(i + 1, k):
                    out.append((sig[at + i], sig[at + j], np.zeros(len(at), np.int32)))
        tied = np.repeat(~few & ((size > 1) | (salt[first] > 0)), size)
        lowest = np.repeat(sig[first], size)
        out.append((sig[tied], lowest[tied], np.ones(tied.sum(), np.int32)))
        common = first[salt[first] > 0]
        out.append((sig[common], h[common], np.full(len(common), 2, np.int32)))
        out.append((sig[tied], sig[tied], np.full(tied.sum(), 3, np.int32)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([x[i] for x in out])) for i in range(3)], names=["a", "b", "kind"])

    held = None
    for batch in batches:
        now = [batch.column(i).to_numpy() for i in range(3)]
        if held is not None:
            now = [np.concatenate(x) for x in zip(held, now, strict=True)]
        if not len(now[0]):
            continue
        # the last column may go on in the next batch
        open_from = int(np.flatnonzero((now[0] != now[0][-1]) | (now[1] != now[1][-1]))[-1]) + 1 if ((now[0] != now[0][-1]) | (now[1] != now[1][-1])).any() else 0
        if open_from:
            yield from columns(*[x[:open_from] for x in now])
        held = [x[open_from:] for x in now]
    if held is not None and len(held[0]):
        yield from columns(*held)


def candidate_groups(docs: DataFrame, rows: DataFrame, n: int, percent: int) -> DataFrame:
    """node (a signature) and component: groups that hold all links of their rows.

    A pair that links shares at least ``p - (n - need)`` of the prefix that ends
    first, with ``p`` its length, ``n`` its row's size and ``need`` the overlap
    that both sizes demand; the smaller of both values is asked for.  Columns in
    which both rows are tied may add to what was counted.
    """
    sorted_rows = _prefixes(docs, n, percent).repartition("h", "salt").sortWithinPartitions("h", "salt", "sig")
    tied = saved(sorted_rows.transform(X.streamed(_within_columns, "a bigint, b bigint, kind int")).groupBy("kind", "a", "b").agg(F.count("*").alias("n")))
    size = saved(rows.where("n > 0").select("sig", "n").distinct())
    often = tied.where("kind = 3").select(F.col("a").alias("sig"), F.col("n").alias("often"))
    info = saved(size.join(often, "sig", "left").select("sig", F.col("n").alias("size"), F.coalesce("often", F.lit(0)).alias("often")))
    side = lambda c: info.select(F.col("sig").alias(c), F.col("size").alias(f"n_{c}"), F.col("often").alias(f"o_{c}"))
    pairs = tied.where("kind = 0").select("a", "b", "n").join(side("a"), "a").join(side("b"), "b")
    prefix = lambda c: F.col(c) - F.ceil(F.col(c) * percent / 100) + 1
    need = F.ceil((F.col("n_a") + F.col("n_b")) * percent / (100 + percent))
    asked = F.least(prefix("n_a") - (F.col("n_a") - need), prefix("n_b") - (F.col("n_b") - need))
    fits = (F.least("n_a", "n_b") * 100 >= F.greatest("n_a", "n_b") * percent) & (F.col("n") + F.least("o_a", "o_b") >= asked)
    heads = tied.where("kind = 2").select(F.col("a").alias("low"), F.col("b").alias("h")).distinct()
    lowest = heads.groupBy("h").agg(F.min("low").alias("lowest"))
    links = pairs.where(fits).select("a", "b").unionByName(tied.where("kind = 1").select("a", "b")).unionByName(heads.join(lowest, "h").select(F.col("low").alias("a"), F.col("lowest").alias("b")))
    groups = components(links)
    dropped(tied, size, info)
    return groups


def _overlaps(cols: np.ndarray, rows: np.ndarray, sizes: np.ndarray, left: np.ndarray, right: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs (left, right) of rows link.  ``cols`` are numbered, ``rows`` tells whose they are."""
    total = 100 + percent
    need = percent * (sizes[left][:, None] + sizes[right][None, :])  # total * overlap must reach it
    count = np.zeros((len(left), len(right)), np.float32)
    place = np.full(len(sizes), -1)
    place[left] = np.arange(len(left))
    lr, lc = place[rows], cols
    keep = lr >= 0
    lr, lc = lr[keep], lc[keep]
    place[:] = -1
    place[right] = np.arange(len(right))
    rr, rc = place[rows], cols
    keep = rr >= 0
    rr, rc = rr[keep], rc[keep]
    both = np.intersect1d(lc, rc)
    lk, rk = np.isin(lc, both), np.isin(rc, both)
    lr, lc, rr, rc = lr[lk], np.searchsorted(both, lc[lk]), rr[rk], np.searchsorted(both, rc[rk])
    left_rest, right_rest = np.bincount(lr, minlength=len(left)), np.bincount(rr, minlength=len(right))
    for lo in range(0, len(both), COLUMNS):
        width = min(COLUMNS, len(both) - lo)
        a, b = np.zeros((len(left), width), np.float32), np.zeros((len(right), width), np.float32)
        la, rb = (lc >= lo) & (lc < lo + width), (rc >= lo) & (rc < lo + width)
        a[lr[la], lc[la] - lo] = 1
        b[rr[rb], rc[rb] - lo] = 1
        count += a @ b.T
        left_rest = left_rest - np.bincount(lr[la], minlength=len(left))
        right_rest = right_rest - np.bincount(rr[rb], minlength=len(right))
        most = count + np.minimum(left_rest[:, None], right_rest[None, :])
        if not (most * total >= need).any():
            break
    return count.astype(np.int64) * total >= need


def _spanning(link: np.ndarray, left: np.ndarray, right: np.ndarray, n: int) -> list[tuple[int, int]]:
    """Links that join each component of a tile: from one row, then from those it reaches."""
    out = []
    seen_left, seen_right = np.zeros(len(left), bool), np.zeros(len(right), bool)
    for i in range(len(left)):
        if seen_left[i]:
            continue
        seen_left[i] = True
        todo = [i]
        while todo:
            a = todo.pop()
            for b in np.flatnonzero(link[a] & ~seen_right).tolist():
                seen_right[b] = True
                out.append((int(left[a]), int(right[b])))
                for c in np.flatnonzero(link[:, b] & ~seen_left).tolist():
                    seen_left[c] = True
                    out.append((int(left[c]), int(right[b])))
                    todo.append(c)
    return out


def block_links(sig: np.ndarray, blobs: list[bytes], block: np.ndarray, percent: int) -> list[tuple[int, int]]:
    """Links that span the components of one pair of blocks (or of one block)."""
    values = [np.frombuffer(x, np.uint64) for x in blobs]
    sizes = np.array([len(v) for v in values], np.int64)
    rows = np.repeat(np.arange(len(values)), sizes)
    _, cols = np.unique(np.concatenate(values), return_inverse=True)
    kinds = np.unique(block)
    left_all = np.flatnonzero(block == kinds[0])
    right_all = np.flatnonzero(block == kinds[-1])
    out = []
    for i in range(0, len(left_all), TILE):
        for j in range(0 if len(kinds) > 1 else i, len(right_all), TILE):
            left, right = left_all[i : i + TILE], right_all[j : j + TILE]
            link = _overlaps(cols, rows, sizes, left, right, percent)
            out.extend((int(sig[a]), int(sig[b])) for a, b in _spanning(link, left, right, len(sizes)) if sig[a] != sig[b])
    return out


def star_links(columns: list[bytes], centre: bytes, percent: int) -> np.ndarray:
    """Which rows link with the centre of their group."""
    c = np.frombuffer(centre, np.uint64)
    values = [np.frombuffer(x, np.uint64) for x in columns]
    size = np.array([len(v) for v in values], np.int64)
    flat = np.concatenate([np.zeros(0, np.uint64), *values])
    at = np.minimum(np.searchsorted(c, flat), len(c) - 1)
    both = np.concatenate([[0], np.cumsum(c[at] == flat)])
    end = np.cumsum(size)
    return (both[end] - both[end - size]) * (100 + percent) >= percent * (size + len(c))


def _columns(docs: DataFrame, members: DataFrame, n: int) -> DataFrame:
    """own and columns of the rows that ``members`` (sig, rep) name.

    Columns come from the row with a signature's smallest id; where all its rows
    lack one, from any, once a task: a signature may come from several rows.
    """
    named, unnamed = members.where("rep is not null"), members.where("rep is null")
    wanted = docs.sparkSession.sparkContext.broadcast((membership(named, "rep", named.count()), membership(unnamed, "sig", unnamed.count())))

    def pick(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, signatures = wanted.value
        sent: set[int] = set()
        for b in batches:
            if b.num_rows:
                b = b.filter(pa.array(b.column(0).is_null().to_numpy(zero_copy_only=False) | ids(b.column(0).fill_null(-1).to_numpy())))
            for lo, hi, w in _read(b.column(1)):
                h, _, bounds = sets(w, n)
                own, lacks = _signatures(h, bounds), b.column(0).slice(lo, hi - lo).is_null().to_numpy(zero_copy_only=False)
                use = ~lacks | signatures(own)
                for k in np.flatnonzero(use & lacks).tolist():
                    use[k] = own[k] not in sent
                    sent.add(int(own[k]))
                use = np.flatnonzero(use)
                yield pa.RecordBatch.from_arrays([pa.array([h[bounds[k] : bounds[k + 1]].tobytes() for k in use.tolist()], pa.binary()), pa.array(own[use])], names=["columns", "own"])

    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").transform(X.streamed(pick, "columns binary, own bigint"))


def _settled(docs: DataFrame, members: DataFrame, n: int, percent: int) -> DataFrame:
    """sig and component of the rows of large groups that link with their group's centre, its row of the smallest id."""
    large = members.where(f"blocks >= {SETTLE}")
    found = large.join(_columns(docs, large, n), F.col("sig") == F.col("own"))
    share = F.when(F.col("sig") == F.col("centre"), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array("block"))
    dealt = found.select("sig", "component", "centre", "columns", F.explode(share).alias("share"))

    def star(table: pa.Table) -> pa.Table:
        sig, centre = table["sig"].to_numpy(), table["centre"][0].as_py()
        middle = table.filter(pa.array(sig == centre))["columns"]
        linked = star_links(table["columns"].to_pylist(), middle[0].as_py(), percent) if len(middle) else np.zeros(len(sig), bool)
        return table.select(["sig", "component"]).filter(pa.array(linked | (sig == centre)))

    return dealt.groupBy("component", "share").applyInArrow(star, "sig bigint, component bigint").distinct()


def join(docs: DataFrame, n: int = 5, percent: int = 75) -> DataFrame:
    """doc_id, n_shingles and component_id (smallest reachable id) for every row of ``docs``."""
    rows = saved(_rows(docs, n), narrow=True)
    first = saved(rows.where("n > 0").groupBy("sig").agg(F.min("doc_id").alias("rep"), F.max("n").alias("n")))
    groups = saved(candidate_groups(docs, rows, n, percent).join(first, F.col("node") == F.col("sig")).select("sig", "rep", "n", "component"))
    order = F.struct(F.col("rep").isNull(), F.col("rep"), F.col("sig"))
    blocks = lambda c: F.greatest(F.least(F.ceil(c / BLOCK), F.lit(MOST_BLOCKS)), F.ceil(c / LARGEST)).cast("int")
    size = groups.groupBy("component").agg(blocks(F.sum("n")).alias("blocks"), F.min_by("sig", order).alias("centre"), F.count("*").alias("rows"))
    size = saved(size)
    sizes = size.agg(F.sum("rows").alias("rows"), F.max("blocks").alias("blocks")).first()
    hot = size.where(F.col("rows") >= frequent(sizes["rows"] or 0)).select("component")
    n_hot = hot.count()
    members = saved(joined(groups, size.drop("rows"), "component", "sig", hot, n_hot).withColumn("block", F.pmod(F.xxhash64("sig"), F.col("blocks")).cast("int")))

    # large groups: rows that link with the centre are one component already; every pair with another row is left
    empty = docs.sparkSession.createDataFrame([], "sig bigint, component bigint")
    settled = saved(_settled(docs, members, n, percent)) if (sizes["blocks"] or 0) >= SETTLE else empty
    stars = members.join(settled, "sig").select(F.col("sig").alias("a"), F.col("centre").alias("b"))
    parts = members.where(f"blocks < {SETTLE} or sig <> centre").join(settled.select(F.col("sig").alias("s")), F.col("sig") == F.col("s"), "left").withColumn("settled", F.col("s").isNotNull()).drop("s", "block", "centre")
    rest = parts.groupBy("component").agg(F.sum(F.when(~F.col("settled"), F.col("n"))).alias("open"), F.sum(F.when(F.col("settled"), F.col("n")).otherwise(0)).alias("shut"))
    rest = rest.where("open > 0").select("component", blocks(F.col("open")).alias("open"), blocks(F.col("shut")).alias("shut"))
    parts = saved(joined(parts, rest, "component", "sig", hot, n_hot).withColumn("cell", F.pmod(F.xxhash64("sig"), F.when(F.col("settled"), F.col("shut")).otherwise(F.col("open"))).cast("int")))
    found = parts.join(_columns(docs, parts, n), F.col("sig") == F.col("own"))
    # an open row meets the open rows of every cell, and the settled rows of every cell (numbered below zero)
    every = lambda many, pair: F.transform(F.sequence(F.lit(0), F.col(many) - 1), pair)
    across = every("open", lambda c: F.struct(F.least("cell", c).alias("p"), F.greatest("cell", c).alias("q")))
    down = F.when(F.col("shut") > 0, every("shut", lambda c: F.struct((-1 - c).alias("p"), F.col("cell").alias("q")))).otherwise(F.array().cast("array<struct<p:int,q:int>>"))
    up = every("open", lambda c: F.struct((-1 - F.col("cell")).alias("p"), c.alias("q")))
    pairs = F.explode(F.when(F.col("settled"), up).otherwise(F.concat(across, down)))
    side = F.when(F.col("settled"), -1).otherwise(F.col("cell"))
    dealt = found.select("sig", side.alias("side"), "columns", "component", pairs.alias("pair")).select("sig", "side", "columns", "component", "pair.p", "pair.q")

    def multiply(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.unique(table["sig"].to_numpy(), return_index=True)[1]))  # a signature may come from several rows
        p, side = table["p"][0].as_py(), table["side"].to_numpy()
        links = []
        if p >= 0 or (len(side) and side.min() < 0 <= side.max()):
            links = block_links(table["sig"].to_numpy(), table["columns"].to_pylist(), side, percent)
        return pa.table({"a": pa.array([a for a, _ in links], pa.int64()), "b": pa.array([b for _, b in links], pa.int64())})

    linked = components(dealt.groupBy("component", "p", "q").applyInArrow(multiply, "a bigint, b bigint").unionByName(stars))
    dropped(parts, members, groups, size)
    # every signature's component, named by the smallest id of its rows
    linked = saved(linked.join(first, F.col("node") == F.col("sig")).select("sig", "rep", "component"))
    lowest = linked.groupBy("component").agg(F.min("rep").alias("lowest"))
    named = saved(linked.join(lowest, "component").select("sig", "lowest"))
    named = saved(first.join(named, "sig", "left").select(F.col("sig").alias("s"), F.coalesce("lowest", "rep").alias("component_id")))
    out = rows.join(named, (F.col("sig") == F.col("s")) & (F.col("n") > 0), "left")
    return out.select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
