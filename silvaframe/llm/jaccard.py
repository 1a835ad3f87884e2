"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import deal, gather, whole_runs
from .common import Scratch, batch_words, connected_components, frugal, mix

#: Rows of a block; members of a share of a class's partners; heavy n-grams that are broadcast; n-grams carried to
#: tell in which column a pair is met first; bits of a filter of ids (2 MB, whatever the input).
BLOCK, SHARE, HEAVY, CARRY, FILTER = 2048, 512, 100_000, 8, 1 << 24
#: Rows of one step of a block's bounds; rows of a unit that is worked through together with others; n-grams of the rows
#: of a block whose overlaps are counted, unless a single row has more.
STEP, NARROW, WEIGHT = 256, 64, 1 << 19


def parity_words(n: int) -> int:
    """Words of 64 bits in the parity map of a set of n members: as many bits as members at least, from 512 to 65,536."""
    return min(1024, max(8, 1 << max(0, (n - 1).bit_length() - 6)))


def parity(s: np.ndarray) -> np.ndarray:
    """A bit for each class of n-grams by their last bits: whether the set holds an odd number of them.

    Bits in which two maps differ are at most the members that only one of the sets has. A map of twice the
    length folds into the shorter one by exclusive or of its halves.
    """
    m = parity_words(len(s)) * 64
    return np.packbits((np.bincount(s & (m - 1), minlength=m) & 1).astype(np.uint8)).view(np.uint64)


def folded(maps: np.ndarray, words: int) -> np.ndarray:
    """Parity maps as columns of [words, rows], brought to a shorter length."""
    while len(maps) > words:
        half = len(maps) // 2
        maps = maps[:half] ^ maps[half:]
    return maps


def shingles(words: np.ndarray, n: int) -> np.ndarray:
    """Sorted distinct hashes of the n-word shingles of a text; fewer words make one, none none."""
    if not len(words):
        return np.zeros(0, np.int64)
    k = min(n, len(words))
    h = np.full(len(words) - k + 1, k if k < n else 0, np.uint64)
    for i in range(k):
        h = mix(h + words[i : len(words) - k + 1 + i] * np.uint64(0x9E3779B97F4A7C15))
    return np.unique(h).view(np.int64)


def _signature(s: np.ndarray) -> tuple[int, int]:
    """128 bits that stand for a set, whatever the order of its members."""
    u = s.view(np.uint64)
    return (int(x.astype(np.int64)) for x in (np.bitwise_xor.reduce(mix(u)), np.add.reduce(mix(u ^ np.uint64(0x5851F42D4C957F2D)))))


def _sets(batch: pa.RecordBatch, n: int):
    """(ids, sets, signatures) of a batch of (doc_id, text)."""
    ids = batch.column(0).to_pylist()
    for i, words in zip(ids, batch_words(batch.column(1))):
        s = shingles(words, n)
        yield i, s, (*_signature(s),) if len(s) else (None, None)


def least_overlap(a, b, percent: int):
    """The least overlap of sets of a and b members whose Jaccard similarity is percent / 100."""
    return -(-percent * (a + b) // (100 + percent))


def prefix_length(n: int, percent: int) -> int:
    """Two similar sets share a member among so many of each's first, in any one order of all n-grams."""
    return n - (percent * n + 99) // 100 + 1


def sampled(s: np.ndarray, percent: int) -> np.ndarray:
    """The n-grams of a set that lie in a fixed share of all hashes, 1.6 times what a set may differ in."""
    share = min(1.0, 1.6 * (100 - percent) / 100)
    return s[(s.view(np.uint64) >> np.uint64(11)) < np.uint64(int(share * 2**53))]


def _describe(n: int, percent: int):
    """Per document its set's size, signature and number of sampled n-grams; per task the n-grams that several of its sets hold."""

    def run(batches):
        seen: set = set()
        counts: list[np.ndarray] = []
        kept = 0
        for batch in batches:
            out, new = [], []
            for i, s, (x, y) in _sets(batch, n):
                out.append((i, len(s), x, y, len(sampled(s, percent))))
                if x is not None and (x, y) not in seen:
                    seen.add((x, y))
                    new.append(s)
            if len(seen) > 30_000:
                seen.clear()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in range(5)] + [pa.nulls(len(out), pa.int64())], ["doc_id", "n_shingles", "s1", "s2", "n_sampled", "gram"])
            counts += new
            kept += sum(map(len, new))
            if kept > 1_000_000:
                yield from _repeated(counts)
                counts, kept = [], 0
        yield from _repeated(counts)

    return run


def _repeated(sets: list[np.ndarray]):
    if sets:
        gram, count = np.unique(np.concatenate(sets), return_counts=True)
        gram, count = gram[count > 2], count[count > 2]
        none = pa.nulls(len(gram), pa.int64())
        yield pa.RecordBatch.from_arrays([none, pa.array(count, pa.int64()), none, none, none, pa.array(gram, pa.int64())], ["doc_id", "n_shingles", "s1", "s2", "n_sampled", "gram"])


def _sample(n: int, percent: int, heavy):
    """Sampled n-grams of each set, once per set and batch, as (gram, s1, 0). Heavy n-grams are known to be shared: they
    stay here, and a row (s1, s1, their number) tells how many the set has, so no n-gram of many sets moves."""

    def run(batches):
        grams, _ = heavy.value
        for batch in batches:
            first = {sig[0]: sampled(s, percent) for _, s, sig in _sets(batch, n) if len(s)}
            if first:
                s1, all_ = np.repeat(np.array(list(first), np.int64), [len(g) for g in first.values()]), np.concatenate(list(first.values()))
                hot = _within(all_, grams)
                own, count = np.unique(s1[hot], return_counts=True)
                columns = np.concatenate([all_[~hot], own]), np.concatenate([s1[~hot], own]), np.concatenate([np.zeros(np.count_nonzero(~hot), np.int64), count])
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["gram", "s1", "hot"])

    return run


def _within(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values a sorted table holds."""
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


def _several(batches):
    """Of rows sorted by (gram, s1): how many n-grams each set shares with another set, summed up per batch; heavy ones apart."""
    held = None  # the last row, and whether its n-gram is known to be shared and the row counted
    for batch in batches:
        g, x, hot = (batch.column(k).to_numpy(zero_copy_only=False) for k in range(3))
        out = [(x[hot > 0], np.zeros(np.count_nonzero(hot), np.int64), hot[hot > 0])]
        g, x = g[hot == 0], x[hot == 0]
        if len(g):
            counted = False
            if held is not None:
                (hg, hx), counted = held
                g, x = np.concatenate([[hg], g]), np.concatenate([[hx], x])
            new = np.ones(len(g), bool)
            new[1:] = (g[1:] != g[:-1]) | (x[1:] != x[:-1])
            g, x = g[new], x[new]
            same = g[1:] == g[:-1]
            shared = np.concatenate([[counted], same]) | np.concatenate([same, [False]])
            last = bool(shared[-1])
            if counted:
                shared[0] = False
            held = (g[-1], x[-1]), last
            sets, count = np.unique(x[shared], return_counts=True)
            out.append((sets, count, np.zeros(len(sets), np.int64)))
        yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c), pa.int64()) for c in zip(*out)], ["s1", "m", "hot"])


def _rows(n: int, percent: int, heavy):
    """Each set's row of the incidence matrix, cut to its prefix (rare n-grams by hash, then heavy ones by count), with
    its size, its parity map and its text, from which the whole row follows. Once per set and batch."""

    def run(batches):
        grams, counts = heavy.value
        for batch in batches:
            first: dict = {}
            for (i, s, sig), text in zip(_sets(batch, n), batch.column(1)):
                if i is None or not len(s):
                    continue
                if sig in first:
                    first[sig] = (min(first[sig][0], i), *first[sig][1:])
                    continue
                k = prefix_length(len(s), percent)
                hot = _within(s, grams)
                cold = s[~hot][:k]
                if len(cold) < k:
                    order = np.lexsort((s[hot], counts[np.searchsorted(grams, s[hot])]))
                    cold = np.concatenate([cold, s[hot][order][: k - len(cold)]])
                first[sig] = (i, len(s), parity(s).tobytes(), cold, text.as_py())
            if first:
                v = list(first.values())
                offsets = np.cumsum([0] + [len(r[3]) for r in v], dtype=np.int32)
                sig = np.array(list(first), np.int64)
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[0] for r in v], pa.int64()), pa.array(sig[:, 0].copy()), pa.array([r[1] for r in v], pa.int64()), pa.array([r[2] for r in v], pa.binary()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([r[3] for r in v]))), pa.array([r[4] for r in v], pa.string())],
                    ["id", "s1", "n", "sketch", "grams", "text"],
                )

    return run


def _picked(bits):
    """Rows (doc_id, text, h) whose h is in a filter of fixed size: all rows asked for, and few others."""

    def run(batches):
        b = bits.value
        for batch in batches:
            h = batch.column(2).to_numpy(zero_copy_only=False)
            yield batch.select([0, 1]).filter(pa.array((b[h >> 3] >> (h & 7).astype(np.uint8) & 1).astype(bool)))

    return run


def _maps(sketches: list[bytes], words: int) -> np.ndarray:
    """Parity maps of one length as columns, so that a word of all rows lies together."""
    return np.ascontiguousarray(np.frombuffer(b"".join(sketches), np.uint64).reshape(len(sketches), words).T)


def _spare(a, b, percent: int):
    """In how many members similar sets of a and b members differ at most."""
    return a + b - 2 * least_overlap(a, b, percent)


class Maps:
    """Parity maps of rows, by length, so that many pairs of rows are compared at once."""

    def __init__(self, sketches: list[bytes]):
        self.words = np.array([len(x) // 8 for x in sketches], np.int64)
        self.place, self.maps = np.zeros(len(sketches), np.int64), {}
        for u in np.unique(self.words):
            rows = np.flatnonzero(self.words == u)
            self.place[rows] = np.arange(len(rows))
            self.maps[u] = _maps([sketches[k] for k in rows], u)

    def apart(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """In how many members at least the sets of each pair of rows differ; none where a row has no map."""
        out = np.zeros(len(i), np.int64)
        kinds = self.words[i] * 2048 + self.words[j]
        for kind in np.unique(kinds):
            u, v = divmod(int(kind), 2048)
            some = np.flatnonzero(kinds == kind)
            w = min(u, v)
            if w:
                x, y = self.maps[u][:, self.place[i[some]]], self.maps[v][:, self.place[j[some]]]
                out[some] = np.bitwise_count(folded(x, w) ^ folded(y, w)).sum(axis=0, dtype=np.int64)
        return out


def _may_link(percent: int):
    """Pairs (a, b, na, nb, sa, sb) that the sizes and the overlap bound of `_meet` do not rule out."""

    def run(batches):
        for t in batches:
            na, nb = t["na"].to_numpy(), t["nb"].to_numpy()
            k = np.arange(len(t))
            apart = Maps([*t["sa"], *t["sb"]]).apart(k, k + len(t))
            keep = (100 * np.minimum(na, nb) >= percent * np.maximum(na, nb)) & (apart <= _spare(na, nb, percent))
            yield t.loc[keep, ["a", "b"]]

    return run


def _near(n: np.ndarray, words: np.ndarray, sketches: list[bytes], left: np.ndarray, right: np.ndarray, may, percent: int):
    """Pairs (i of left, j of right) for which `may` holds and that neither sizes nor parity maps rule out.

    `may(i, j)` takes a column of rows and a row of rows. Rows without a map stand for several texts: nothing bounds them.
    """
    for u in np.unique(words[left]):
        for v in np.unique(words[right]):
            rows, cols, w = left[words[left] == u], right[words[right] == v], min(u, v)
            if w:
                x, y = (folded(_maps([sketches[k] for k in at], m), w) for at, m in ((rows, u), (cols, v)))
            for at in range(0, len(rows), STEP):
                i = rows[at : at + STEP]
                ok = may(i[:, None], cols[None, :])
                if w:
                    a, b = n[i][:, None], n[cols][None, :]
                    ok &= 100 * np.minimum(a, b) >= percent * np.maximum(a, b)
                if not ok.any():
                    continue
                if not w:
                    p, q = np.nonzero(ok)
                elif 8 * np.count_nonzero(ok) < ok.size:
                    p, q = np.nonzero(ok)
                    apart = np.zeros(len(p), np.int64)
                    for k in range(w):
                        apart += np.bitwise_count(x[k, at + p] ^ y[k, q])
                    near = apart <= _spare(n[i[p]], n[cols[q]], percent)
                    p, q = p[near], q[near]
                else:
                    apart = np.zeros(ok.shape, np.uint32)
                    for k in range(w):
                        apart += np.bitwise_count(x[k, at : at + STEP, None] ^ y[k, None, :])
                    p, q = np.nonzero(ok & (apart <= _spare(a, b, percent)))
                if len(p):
                    yield i[p], cols[q]


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels, each the least row of its cluster, once rows a and b are in one cluster each."""
    while True:
        low, new = np.minimum(label[a], label[b]), label.copy()
        for at in (a, b, label[a], label[b]):
            np.minimum.at(new, at, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _meet(percent: int):
    """Rows of a unit, a block of rows by a block of rows of one column, that may be similar to another one and are not
    linked to it yet, with the cluster of rows that such pairs make up: a row per row, however many pairs there are.

    What two rows differ in is bounded from below by their parity maps, and pairs whose sizes ask for a
    larger overlap are discarded. A pair that shares an earlier carried column is left to that column. Narrow units are
    worked through together, pairs of one distance in the frame at a time, wide ones by blocks.
    """

    def run(batches):
        for frame, bounds in whole_runs(batches, ["gram", "band", "_lo", "_hi"]):
            n, ids, own, part, home, gram = (frame[c].to_numpy() for c in ("n", "id", "_own", "part", "home", "gram"))
            across, sketches = (frame["_lo"] != frame["_hi"]).to_numpy(), list(frame["sketch"])
            maps, carry = Maps(sketches), np.repeat(gram[:, None], CARRY, axis=1)  # filled up with the column itself, which is no earlier one
            lengths = frame["carry"].map(len).to_numpy()
            filled = np.arange(CARRY)[None, :] < lengths[:, None]
            carry[filled] = np.concatenate(frame["carry"].to_numpy())

            def may(i, j):
                return (part[i] != part[j]) & (home[i] | home[j]) & (~across[i] | (own[i] != own[j]))

            def found():
                sizes = np.diff(bounds)
                end = np.repeat(np.where(sizes <= NARROW, bounds[1:], 0), sizes)
                i, d = np.arange(len(frame)), 0
                while len(i := i[i + d + 1 < end[i]]):
                    d += 1
                    a, b = i, i + d
                    ok = may(a, b)
                    small, large = np.minimum(n[a], n[b]), np.maximum(n[a], n[b])
                    ok &= (100 * small >= percent * large) | (maps.words[a] == 0) | (maps.words[b] == 0)
                    a, b = a[ok], b[ok]
                    near = (maps.apart(a, b) <= _spare(n[a], n[b], percent)) | (maps.words[a] == 0) | (maps.words[b] == 0)
                    yield a[near], b[near]
                for at, to in zip(bounds[:-1][sizes > NARROW], bounds[1:][sizes > NARROW]):
                    rows = np.arange(at, to)
                    left, right = (rows[own[rows] == own[rows].min()], rows[own[rows] == own[rows].max()]) if across[at] else (rows, rows)
                    yield from _near(n, maps.words, sketches, left, right, may if across[at] else lambda i, j: may(i, j) & (i < j), percent)

            label, held, count = np.arange(len(frame)), [], 0
            for a, b in found():
                for at in range(0, len(a), 8192):
                    i, j = a[at : at + 8192], b[at : at + 8192]
                    first = ~((carry[i][:, :, None] == carry[j][:, None, :]) & (carry[i] < gram[i][:, None])[:, :, None]).any(axis=(1, 2))
                    held.append((i[first], j[first]))
                    count += len(held[-1][0])
                if count > 100_000:
                    label, held, count = _joined(label, *map(np.concatenate, zip(*held))), [], 0
            if count:
                label = _joined(label, *map(np.concatenate, zip(*held)))
            met = np.flatnonzero(np.bincount(label, minlength=len(label))[label] > 1)
            if len(met):
                out = frame.iloc[met][["gram", "band", "_lo", "_hi", "id", "part", "n"]]
                yield out.assign(cluster=ids[label[met]], side=np.where(across[met], own[met], -1))

    return run


def _product(n: int, percent: int):
    """A spanning forest of the links (a, b) among the rows of each unit (unit, _lo, _hi, id, part, side, _own, text).

    The unit's rows of the incidence matrix times their transpose, a row by a block of rows at a time: overlap counts are
    added up over all n-grams that two rows of the unit hold, and pairs below the overlap that their sizes ask for go. The
    bounds by sizes and parity maps mask the block; so does what is linked already, by part or by an earlier row.
    """

    def links(key, rows: list[tuple]):
        if len(rows) < 2:
            return
        ids, part, side, own = (np.array([r[k] for r in rows], np.int64) for k in range(4))
        sets = [r[4] for r in rows]
        sizes, across = np.array([len(s) for s in sets]), key[1] != key[2]
        _, local, held = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
        common = held[local] > 1
        ends = np.concatenate([[0], np.cumsum(common)])[np.cumsum(sizes)]
        starts, local = np.concatenate([[0], ends[:-1]]), local[common].astype(np.int32)
        mark, label = np.zeros(len(held), bool), np.unique(part, return_inverse=True)[1]
        maps = Maps([parity(s).tobytes() for s in sets])
        for i in range(len(rows) - 1):
            small, large = np.minimum(sizes, sizes[i]), np.maximum(sizes, sizes[i])
            ok = (label != label[i]) & ((side != side[i]) | (side < 0)) & (100 * small >= percent * large)
            if across:
                ok &= own != own[i]
            j = i + 1 + np.flatnonzero(ok[i + 1 :])
            j = j[maps.apart(np.full(len(j), i), j) <= _spare(sizes[i], sizes[j], percent)]
            if not len(j):
                continue
            mark[local[starts[i] : ends[i]]] = True
            lengths = ends[j] - starts[j]
            for block in np.split(j, np.flatnonzero(np.diff(np.cumsum(lengths) >> 20)) + 1):
                hits = np.concatenate([[0], np.cumsum(mark[np.concatenate([local[starts[k] : ends[k]] for k in block])])])
                at = np.cumsum(ends[block] - starts[block])
                overlap = hits[at] - hits[at - ends[block] + starts[block]]
                for k in block[overlap >= least_overlap(sizes[block], sizes[i], percent)]:
                    if label[k] != label[i]:
                        label[label == label[k]] = label[i]
                        yield ids[i], ids[k]
            mark[local[starts[i] : ends[i]]] = False

    def batch_of(found):
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in found], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches):
        key, rows = None, []
        for batch in batches:
            found = []
            for *row, words in zip(*(batch.column(k).to_pylist() for k in range(7)), batch_words(batch.column(7))):
                if row[:3] != key:
                    found += links(key, rows)
                    key, rows = row[:3], []
                rows.append((*row[3:], shingles(words, n)))
            yield batch_of(found)
        yield batch_of(list(links(key, rows)))

    return run


def _count(n: int, percent: int):
    """Whole overlap counts of rows (a, b, text of b), after a row (a, null, text of a): the product of a's row of the
    matrix with a block of rows, stacked. Counts add up over all columns; pairs below the overlap that their sizes ask for go."""

    def overlaps(rows: list[np.ndarray], hub: np.ndarray) -> np.ndarray:
        sizes = np.array([len(r) for r in rows])
        hits = np.concatenate([[0], np.cumsum(_within(np.concatenate(rows).view(np.uint64), hub.view(np.uint64)))])  # sets are in unsigned order
        ends = np.cumsum(sizes)
        return hits[ends] - hits[ends - sizes] >= least_overlap(sizes, len(hub), percent)

    def run(batches):
        hub, sets = None, []
        for batch in batches:
            out, block = [], []

            def flush():
                for k in range(0, len(block), 64):
                    ids, rows = zip(*block[k : k + 64])
                    linked = np.any([overlaps(rows, t) for t in sets], axis=0)
                    out.extend((hub, i) for i, yes in zip(ids, linked) if yes)
                block.clear()

            for a, b, words in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch_words(batch.column(2))):
                s = shingles(words, n)
                if b is None:
                    if block:
                        flush()
                    hub, sets = a, [*(sets if hub == a else []), s]
                else:
                    block.append((b, s))
            if block:
                flush()
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], pa.int64()) for k in (0, 1)], ["a", "b"])

    return run


def jaccard_components(documents: DataFrame, n: int = 3, percent: int = 90, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_shingles, component_id), a row per document; similar: 100 * overlap >= percent * union.

    Equal sets are one class from the start. A class is left out if, within a fixed share of all n-grams,
    it has more of its own than its size lets a partner miss. The incidence matrix of the others is cut to
    their prefix columns, whose length follows from the size. Links of each class with the first class of most of its
    columns join most copies; columns that then still hold several parts are multiplied in blocks of rows: wide columns
    are dealt out by bands of size, so that rows whose sizes rule each other out never meet, and by blocks within a band.
    Rows that the sizes and the bound on what they differ in leave with a possible partner are gathered by clusters, where
    the blocked product adds up whole overlap counts; a cluster hands on a spanning forest of its links, so what is written
    follows the rows, not their pairs. Pairs within one part need no count.

    Null, empty and blank texts have no shingles and link with nothing; a text of fewer than n words is
    one shingle. Rows that share an id count as one document with all their links. A null id links with
    nothing else than copies of its text. Only the id and text columns are read. Three passes over the texts.
    """
    spark = documents.sparkSession
    scratch = Scratch(spark, "jaccard")
    docs = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    # 1. sizes and signatures, and n-grams that many sets hold
    seen = scratch.save(docs.mapInArrow(frugal(_describe(n, percent)), "doc_id long, n_shingles long, s1 long, s2 long, n_sampled long, gram long"))
    rows = seen.where("gram is null").drop("gram")
    top = seen.where("gram is not null").groupBy("gram").agg(F.sum("n_shingles").alias("c")).where("c >= 8").orderBy(F.desc("c"), "gram").limit(HEAVY)
    top = sorted((r.gram, r.c) for r in top.collect())  # at most HEAVY rows
    heavy = spark.sparkContext.broadcast((np.array([g for g, _ in top], np.int64), np.array([c for _, c in top], np.int64)))
    # 2. classes that may have a partner: a set with so many n-grams of its own that no overlap suffices has none
    sample = docs.mapInArrow(frugal(_sample(n, percent, heavy)), "gram long, s1 long, hot long").repartition("gram").sortWithinPartitions("gram", "s1")
    common = sample.mapInArrow(frugal(_several), "s1 long, m long, hot long").groupBy("s1").agg((F.sum("m") + F.max("hot")).alias("m"))
    classes = rows.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id"), F.first("n_shingles").alias("n"), F.first("n_sampled").alias("k"))
    own = F.col("k") - F.coalesce("m", F.lit(0))
    active = classes.join(common, "s1", "left").where(own < F.col("n") - F.expr(f"({percent} * n + 99) div 100") + 1)
    active = scratch.save(active.where("id is not null").select(F.col("id").alias("doc_id")))

    # 3. their rows of the matrix, by a scan past a filter of ids of fixed size, so that no text is shuffled to be dropped
    at = F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)) + 1
    maps = active.groupBy(F.bitmap_bucket_number(at).alias("k")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(at)).alias("bits")).collect()  # FILTER bits at most
    bits = np.zeros(FILTER >> 3, np.uint8)
    for r in maps:
        bits[(r.k - 1) * 4096 : r.k * 4096] = np.frombuffer(r.bits, np.uint8)
    pick, row = _picked(spark.sparkContext.broadcast(bits)), _rows(n, percent, heavy)
    hashed = docs.withColumn("h", F.pmod(F.xxhash64("doc_id"), F.lit(FILTER)))
    matrix = scratch.save(hashed.mapInArrow(frugal(lambda batches: row(pick(batches))), "id long, s1 long, n long, sketch binary, grams array<long>, text string"))
    facts = matrix.groupBy("id").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch"), F.count_distinct("s1").alias("texts"))
    # an id with several texts has no one parity map: none that rules out nothing stands for it
    facts = facts.select("id", "n", F.when(F.col("texts") == 1, F.col("sketch")).otherwise(F.lit(b"")).alias("sketch"), "texts")
    # the columns that two classes or more share; hub is the first class of a column
    columns = matrix.select(F.explode("grams").alias("gram"), "id")
    held = columns.groupBy("gram").agg(F.min("id").alias("hub"), F.max("id").alias("last")).where("hub <> last").drop("last")
    shared = scratch.save(columns.join(held, "gram"))

    def verify(pairs: DataFrame) -> DataFrame:
        """Pairs (a, b) whose whole overlap count suffices. Only texts of these pairs move, and a text is smaller than its set.
        A class with many partners is dealt out with a share of them each."""
        texts = matrix.select(F.col("id").alias("doc_id"), "text")
        pairs = scratch.save(pairs)
        many = pairs.groupBy("a").agg(F.expr(f"int((count(1) + {SHARE - 1}) div {SHARE})").alias("shares"))
        hubs = many.select("a", F.explode(F.sequence(F.lit(0), F.col("shares") - 1)).alias("share"), F.lit(None).cast("long").alias("b"), F.col("a").alias("doc_id"))
        dealt = pairs.join(many, "a").select("a", F.pmod(F.xxhash64("b"), "shares").cast("int").alias("share"), "b", F.col("b").alias("doc_id"))
        dealt = dealt.unionByName(hubs).join(texts, "doc_id").repartition("a", "share").sortWithinPartitions("a", "share", "b").select("a", "b", "text")
        return dealt.mapInArrow(frugal(_count(n, percent)), "a long, b long").distinct()

    def parts(links: DataFrame) -> DataFrame:
        return scratch.save(connected_components(links, scratch).select("id", F.col("component").alias("part")))

    # 4. each class with the hub of most of its columns joins most copies
    often = shared.where("id <> hub").groupBy("id", "hub").agg(F.count(F.lit(1)).alias("m")).groupBy("id").agg(F.max_by("hub", F.struct("m", "hub")).alias("hub"))
    often = often.select(F.least("id", "hub").alias("a"), F.greatest("id", "hub").alias("b")).distinct()
    of = lambda x: facts.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("texts").alias(f"t{x}"))
    often = often.join(of("a"), "a").join(of("b"), "b")
    single = often.where("ta = 1 and tb = 1").select("a", "b", "na", "nb", "sa", "sb").mapInPandas(frugal(_may_link(percent)), "a long, b long")
    links = scratch.save(verify(single.unionByName(often.where("ta > 1 or tb > 1").select("a", "b"))))
    part = parts(links)
    # 5. the product of the columns that still hold several parts, in blocks
    open_ = shared.select("gram", "id").join(part, "id", "left").select("gram", "id", F.coalesce("part", "id").alias("part"))
    mixed = open_.groupBy("gram").agg(F.min("part").alias("x"), F.max("part").alias("y"), F.count(F.lit(1)).alias("m")).where("x <> y").select("gram", (F.col("m") > BLOCK).alias("wide"))
    open_ = scratch.save(open_.join(mixed, "gram"))
    carry = open_.groupBy("id").agg(F.slice(F.array_sort(F.collect_set("gram")), 1, CARRY).alias("carry"))
    met = gather(deal(_banded(open_, facts, percent), ["gram", "band"], "id", BLOCK).join(facts.drop("texts"), "id").join(carry, "id"), ["gram", "band"])
    met = met.mapInPandas(frugal(_meet(percent)), "gram long, band int, _lo int, _hi int, id long, part long, n long, cluster long, side int")
    met = scratch.save(met.select(F.xxhash64("gram", "band", "_lo", "_hi", "cluster").alias("unit"), "id", "part", "n", "side"))
    # 6. whole overlap counts within each cluster; only texts of these rows move, and a text is smaller than its set
    dealt = deal(met, ["unit"], "id", WEIGHT, "n").join(matrix.select("id", "text"), "id")
    dealt = gather(dealt.select("unit", "_lo", "_hi", "id", "part", "side", "_own", "text"), ["unit"])
    links = scratch.save(links.unionByName(dealt.mapInArrow(frugal(_product(n, percent)), "a long, b long")))
    part = parts(links)
    label = part.withColumnRenamed("part", "component")
    scratch.drop(active, matrix, shared, open_, met, links)
    heavy.destroy()
    # 7. back to the documents
    classes = rows.where("s1 is not null").groupBy("s1", "s2").agg(F.min("doc_id").alias("id")).join(label, "id", "left").select("s1", "s2", F.coalesce("component", "id").alias("component_id"))
    full = rows.where("s1 is not null").join(classes, ["s1", "s2"]).select("doc_id", "n_shingles", "component_id")
    return full.unionByName(rows.where("s1 is null").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _banded(entries: DataFrame, facts: DataFrame, percent: int) -> DataFrame:
    """Entries (gram, id, part, wide) with their band, and whether they are at home there.

    Bands are powers of 100 / percent, so similar sets lie in one band or in neighbours: in wide columns a row is at
    home in its own band and visits the next one, and pairs with one at home at least are compared. An id with several
    texts (an empty map) visits all bands. Other columns are one band.
    """
    step = 1.001 * math.log(100 / percent) if percent < 100 else 1.0  # a little wider than the ratio, for rounding
    band = F.floor(F.log("n") / step).cast("int")
    every = F.transform(F.sequence(F.lit(0), F.lit(int(45 / step) + 1)), lambda b: F.struct(b.alias("band"), (b == 0).alias("home")))
    own = F.array(F.struct(band.alias("band"), F.lit(True).alias("home")), F.struct((band + 1).alias("band"), F.lit(False).alias("home")))
    wide = entries.where("wide").join(facts.select("id", "n", "sketch"), "id")
    wide = wide.select("gram", "id", "part", F.inline(F.when(F.octet_length("sketch") == 0, every).otherwise(own)))
    return wide.unionByName(entries.where("not wide").select("gram", "id", "part", F.lit(-1).alias("band"), F.lit(True).alias("home")))


def jaccard_oracle() -> str:
    """Brute force in DuckDB: all pairs of documents that share a shingle, and recursive reachability."""
    return r"""
    WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
    s AS (SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
      ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g FROM w),
    t AS (SELECT doc_id, len(g) AS n, unnest(g) AS g FROM s),
    o AS (SELECT x.doc_id AS a, y.doc_id AS b, any_value(x.n) AS na, any_value(y.n) AS nb, count(*) AS c
      FROM t x JOIN t y ON x.g = y.g AND x.doc_id <> y.doc_id AND 10 * least(x.n, y.n) >= 9 * greatest(x.n, y.n) GROUP BY 1, 2),
    l AS (SELECT a, b FROM o WHERE 100 * c >= 90 * (na + nb - c)),
    r AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT r.a, l.b FROM r JOIN l ON r.b = l.a)
    SELECT s.doc_id, len(s.g)::BIGINT AS n_shingles, min(r.b) AS component_id FROM s JOIN r ON r.a = s.doc_id GROUP BY s.doc_id, s.g"""
