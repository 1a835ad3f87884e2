"""Nearest neighbours, structure repair and fill-in-middle against brute force."""

import hashlib
import itertools
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from silvaframe.llm import fim, postings, structure

VECTORS = "vec_id long, embedding array<double>, label int, h1 long, least string, space int, score double"


def vectors_frame(spark, rows):
    """Vectors with extra columns whose names clash with what the operator uses inside."""
    return spark.createDataFrame([(i, v, 0, 1, "x", 2, 0.5) for i, v in rows], VECTORS)


def exact(rows, every, k):
    ok = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(c is not None and math.isfinite(c) for c in v) and any(v)}
    out = {}
    for i, v in ok:
        if i % every == 0:
            near = sorted((math.dist(v, w), j) for j, w in ok if j != i and len(w) == len(v))
            out.setdefault(i, []).append(near[:k])
    return out


def test_neighbours_of_odd_rows(spark):
    """Nulls, zeros, copies, ties, short tables and lengths of their own: all lists are read here, so the result is exact."""
    rng = random.Random(2)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(200)]
    rows += [(300 + i, list(rows[7][1])) for i in range(40)]  # copies: more than a result holds
    rows += [(400, None), (500, [0.0] * 5), (600, [1.0, None, 0.0, 0.0, 0.0]), (700, [float("nan")] * 5), (800, [float("inf")] + [0.0] * 4), (None, [1.0] * 5), (100, rows[100][1])]
    rows += [(900, [1.0, 2.0]), (901, [1.0, 2.5]), (1000, []), (1100, [-0.0, 1.0]), (1101, [0.0, 1.0])]
    frame = vectors_frame(spark, rows)
    found = {}
    for r in postings.nearest(frame, frame.where("vec_id % 100 = 0")).collect():
        found.setdefault(r.query_id, {})[r.rank] = (r.score, r.vec_id)
    want = exact(rows, 100, 10)
    assert set(found) == {i for i, lists in want.items() if lists[0]} == {0, 100, 300, 900, 1100}
    for i, near in found.items():
        assert sorted(near) == list(range(1, len(near) + 1))
        got = [near[k] for k in sorted(near)]
        assert [j for _, j in got] == [j for _, j in want[i][0]] and np.allclose([s for s, _ in got], [s for s, _ in want[i][0]], rtol=1e-12)
    assert found[300][1] == (0.0, 7) and [j for _, j in (found[300][k] for k in range(2, 5))] == [301, 302, 303] and found[1100][1] == (0.0, 1101)
    assert postings.nearest(frame.limit(0), frame.limit(0)).count() == 0 and postings.nearest(frame, frame.limit(0)).count() == 0
    assert postings.nearest(frame, frame.where("vec_id = 0"), k=3).count() == 3


def test_neighbours_recall(spark):
    """A mixture of a dense group of near copies and scattered vectors, in lists of many blocks."""
    rng = np.random.default_rng(3)
    dense = rng.normal(size=16) + 0.02 * rng.normal(size=(1500, 16))
    x = np.concatenate([dense, rng.normal(size=(3500, 16))])
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(x)]
    frame = vectors_frame(spark, rows)
    found = {(r.query_id, r.vec_id) for r in postings.nearest(frame, frame.where("vec_id % 50 = 0")).collect()}
    want = set()
    for q in range(0, 5000, 50):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        want |= {(q, int(j)) for j in np.argsort(d)[:10]}
    assert len(found) == len(want) == 1000 and len(found & want) >= 0.93 * len(want)


def test_index_reads_few_lists_and_blocks_lose_nothing(monkeypatch):
    rng = np.random.default_rng(5)
    centres = rng.normal(size=(40, 8)) * 10
    x = centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 8))
    index = postings.fit(x[:6000], len(x))
    rows, lists = index.lists(x)
    assert set(rows) == set(range(len(x))) and 1 <= len(rows) / len(x) <= postings.COPIES
    sizes = np.bincount(lists, minlength=len(index.centroids))
    assert np.median(sizes) > postings.LIST / 2 and sizes.max() < 20 * postings.LIST
    q, read = index.probes(x[:200])
    assert len(read) / 200 < 0.5 * len(index.centroids)
    # the walk through the graph meets what a look at all centroids finds
    d = postings.distances(x[:200], index.centroids)
    bar = np.maximum(index.ratio * d.min(1), np.partition(d, postings.LEAST - 1, axis=1)[:, postings.LEAST - 1])
    assert len(read) >= 0.98 * np.count_nonzero(d <= bar[:, None] * (1 - 1e-9))
    # of one batch and of many slices of it the nearest are the same
    a = postings.nearest_rows(x[:50], x[100:4000], np.arange(3900), 7)
    best = [np.sort(np.sqrt(((x[100:4000] - v) ** 2).sum(1)))[:7] for v in x[:50]]
    assert np.allclose(a[2].reshape(50, 7), best)


def plain_structure(rows, costs=structure.Costs()):
    """The cheapest edits by a search over all of them, row by row."""
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1].encode(), hashlib.md5(r[2].encode()).hexdigest()))
    seen, faults = set(), []
    for _, role, text in rows:
        core = text.rstrip(" \t\n\x0b\x0c\r")
        faults.append("blank" if not core else "duplicate" if (role, text) in seen else "truncated" if core[-1] not in ".!?" else "")
        seen.add((role, text))
    legal = lambda s: re.fullmatch("(s?(ua)+)?", s) is not None
    prefix = lambda s: any(legal(s + t) for t in ("", "a", "ua"))
    best = {(0, ""): (0, "", ())}  # (rows done, last initials) to the cheapest edits
    state = lambda s: {"": "", "s": "s", "u": "u", "a": "ua"}[s[-1:]]
    for at in range(len(rows) + 1):
        for _ in range(3):  # inserts
            for (k, s), (c, audit, lines) in list(best.items()):
                if k == at:
                    for r in "ua":
                        if prefix(s + r):
                            new = (c + costs.insert, audit + "I", (*lines, {"u": "user:", "a": "assistant:"}[r]))
                            key = (k, state(s + r))
                            best[key] = min(best.get(key, new), new)
        if at == len(rows):
            break
        _, role, text = rows[at]
        for (k, s), (c, audit, lines) in list(best.items()):
            if k != at:
                continue
            moves = [(costs.delete, "D", s, lines)]
            if faults[at] not in ("blank", "duplicate"):
                more = costs.truncated if faults[at] == "truncated" else 0
                moves += [(more, "K", s + role[:1], (*lines, f"{role}:{text}"))] if role[:1] in tuple("sua") else []
                moves += [(costs.rerole + more, "R", s + n[0], (*lines, f"{n}:{text}")) for n in ("user", "assistant")]
            for d, letter, t, out in moves:
                if prefix(t):
                    new, key = (c + d, audit + letter, out), (at + 1, state(t))
                    best[key] = min(best.get(key, new), new)
    cost, audit, lines = min(v for (k, s), v in best.items() if k == len(rows) and legal(s))
    turns = [t for t, *_ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    illegal = sum(a[1][:1] + b[1][:1] not in ("su", "ua", "au") for a, b in zip(rows, rows[1:]))
    return (gaps, *(faults.count(f) for f in ("blank", "duplicate", "truncated")), illegal, cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())


TURNS = "conv_id long, turn long, role string, text string, ck string, at int, pos string, fault string, copies int"


def turns_frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, "y", "z", 7) for r in rows], TURNS)


@pytest.fixture(scope="module")
def turns():
    rng = random.Random(6)
    texts = ["Well.", "Is it so?", "No end", "", " \n", "Done!", "Then  \t", "é…", "A. ", "word " * 300 + "."]
    rows = []
    for c in range(150):
        for t in range(rng.randint(1, 9)):
            rows.append((c, rng.choice([t, t, t, t + 2, None]), rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None]), rng.choice([*texts, None])))
    rows += [(None, t, "user", "Hello.") for t in range(3)] + [(500, None, "user", "Same.")] * 40 + [(501, t, ("user", "assistant")[t % 2], f"Turn {t}.") for t in range(70)]
    return rows


def digested(spark, rows, **kw):
    frame = turns_frame(spark, rows)
    found = structure.digest(frame, structure.repair_structure(frame, **kw)).collect()
    return {r.conv_id: (r.gaps, r.blank, r.duplicate, r.truncated, r.illegal, r.cost, r.audit, r.repaired_sha256) for r in found}


def plain(rows, **kw):
    by = {}
    for c, t, role, text in rows:
        by.setdefault(c, []).append((t, " " if role is None else role, " " if text is None else text))
    return {c: plain_structure(own, **kw) for c, own in by.items()}


def test_structure_equals_a_search_of_all_edits(spark, turns):
    assert digested(spark, turns) == plain(turns)
    costs = structure.Costs(rerole=3, delete=3, insert=2, truncated=1)
    assert digested(spark, turns, costs=costs) == plain(turns, costs=costs)


def test_structure_in_pieces_and_levels(spark, turns, monkeypatch):
    """Conversations cut into pieces of two rows, composed in levels of two."""
    monkeypatch.setattr(structure, "PIECE", 2)
    monkeypatch.setattr(structure, "FAN", 2)
    some = [r for r in turns if r[0] is None or r[0] % 9 == 0 or r[0] >= 500]
    assert digested(spark, some) == plain(some)


def test_structure_of_nothing_and_partitions(spark, turns):
    assert digested(spark, []) == {}
    frame = turns_frame(spark, turns[:300])
    one = structure.digest(frame, structure.repair_structure(frame.repartition(7, "text")))
    assert {tuple(r) for r in one.collect()} == {tuple(r) for r in structure.digest(frame, structure.repair_structure(frame.coalesce(1))).collect()}
    # what is left of each conversation reads as it should
    edits = structure.repair_structure(frame).turns
    for conv, own in itertools.groupby(sorted(edits.collect(), key=lambda r: (r.ck, r.at, r.pos)), key=lambda r: r.ck):
        roles = [x for r in own for x in [*r.before, *([r.new_role] if r.edit != "D" else []), *r.after]]
        assert re.fullmatch("(s?(ua)+)?", "".join(x[0] for x in roles))


def test_damage_by_checksum(spark):
    rows = [(c, t, "assistant", f"One. Two! {t}?") for c in range(20) for t in range(10)] + [(None, 1, None, None), (3, None, "user", "Hm.")]
    want = []
    for c, t, role, text in rows:
        kind = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        role, text = " " if role is None else role, " " if text is None else text
        row = (c, t, "user" if kind == 4 else role, "" if kind == 1 else re.sub("[.!?]", "", text) if kind == 2 else text)
        want += [row] * (0 if kind == 0 else 2 if kind == 3 else 1)
    key = lambda r: tuple((x is not None, x) for x in r)
    assert sorted(map(tuple, structure.damaged(turns_frame(spark, rows)).collect()), key=key) == sorted(want, key=key)
    lost = [(c, t, "user", "x") for c in range(300) for t in range(1) if zlib.crc32(f"{c}:{t}".encode()) % 20 == 0]
    frame = turns_frame(spark, lost)
    out = structure.digest(frame, structure.repair_structure(structure.damaged(frame))).collect()
    assert len(out) == len(lost) > 3 and all(tuple(r)[1:] == (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for r in out)


TEXTS = [None, "", "\n", "one line", "a\nb\nc", "a\n\n\nb\n", "é漢\n😀 x\r\ny\x00z", "has <P> in it\n", "<S>", "<M", "<\n<\nS>\n", "tail<\nP>\nx", "line\n" * 4000, "x" * 200_000, ("y" * 70_000 + "\n") * 3 + "z"]
DOCS = "doc_id long, text string, n int, form string, output string"


def test_fill_in_middle(spark):
    rows = [(i, TEXTS[i % len(TEXTS)], 1, "x", "y") for i in range(150)] + [(None, "a\nb\n", 1, "x", "y"), (4, TEXTS[4], 1, "x", "y")]
    frame = spark.createDataFrame(rows, DOCS)
    out = fim.fill_in_middle(frame)
    both = out.withColumn("back", fim.restored(F.col("output"), F.col("form"))).collect()
    assert len(both) == len(rows)
    texts, forms = {(i, t or "") for i, t, *_ in rows}, set()
    digest = {(r.doc_id, r.output_sha256): r for r in fim.digest(out).collect()}
    for r in both:
        text = r.back
        assert (r.doc_id, text) in texts
        units = re.findall(r"[^\n]*\n|[^\n]+", text)
        h = hashlib.sha256(f"7:{'' if r.doc_id is None else r.doc_id}".encode()).hexdigest()
        h1, h2, _, h4 = (int(h[8 * k : 8 * k + 8], 16) for k in range(4))
        a, b = sorted((h1 % (len(units) + 1), h2 % (len(units) + 1)))
        p, m, s = ("".join(u) for u in (units[:a], units[a:b], units[b:]))
        form = "plain" if not text or re.search("<[PSM]>", text) else "spm" if h4 % 100 < 50 else "psm"
        want = {"plain": text, "psm": f"<P>{p}<S>{s}<M>{m}", "spm": f"<S>{s}<P>{p}<M>{m}"}[form]
        assert (r.n, r.form, r.output) == (len(units), form, want)
        assert (r.prefix_chars, r.middle_chars) == ((None, None) if form == "plain" else (len(p), len(m)))
        d = digest[r.doc_id, hashlib.sha256(want.encode()).hexdigest()]
        assert d.restored_sha256 == hashlib.sha256(text.encode()).hexdigest()
        forms.add(form)
    assert forms == {"plain", "psm", "spm"}
    assert fim.fill_in_middle(frame.limit(0)).count() == 0
    assert {r.form for r in fim.fill_in_middle(frame, rate=0).collect()} == {"plain"} and "psm" not in {r.form for r in fim.fill_in_middle(frame, spm=100).collect()}


def test_stretches_of_long_texts(monkeypatch):
    from tokenizers import Regex, pre_tokenizers

    split = pre_tokenizers.Split(Regex(fim.LINE), "isolated")
    for size in (1, 3, 1 << 16):
        monkeypatch.setattr(fim, "STRETCH", size)
        for t in TEXTS[1:]:
            if len(t) < 10_000:
                assert fim.unit_ends(t, split).tolist() == [0, *[m.end() for m in re.finditer(fim.LINE, t)]]
