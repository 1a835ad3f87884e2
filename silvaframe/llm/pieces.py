"""SentencePiece encoding and decoding by a streaming Viterbi pass."""

from __future__ import annotations

import re
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import frugal, mix, short_batches

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = "▁"
#: Segments whose ids a worker remembers at most, in each of two generations, and the longest segment that is remembered.
REMEMBERED, SHORT = 40_000, 64
#: Windows of this many of the longest piece; characters that are segmented together; lanes from which they advance in step.
WINDOW, TOGETHER, LANES = 4, 100_000, 8
#: Slots of the memory of pairs of pieces (a power of two): 5 MB, whatever the input.
PAIRS = 1 << 19


class Table:
    """From non-negative 62-bit keys to values, for whole arrays at once: a hash table with linear probing."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.mask = (1 << max(4, int(3 * max(len(keys), 1)).bit_length())) - 1
        self.keys = np.full(self.mask + 1, -1, np.int64)
        self.values = np.full(self.mask + 1, -1, np.int32)
        todo, at = np.arange(len(keys)), self._slot(keys)
        while len(todo):
            free = self.keys[at] < 0
            _, first = np.unique(np.where(free, at, -1 - np.arange(len(at))), return_index=True)
            won = first[free[first]]
            self.keys[at[won]], self.values[at[won]] = keys[todo[won]], values[todo[won]]
            lost = np.ones(len(todo), bool)
            lost[won] = False
            todo, at = todo[lost], at[lost] + 1 & self.mask

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (mix(keys.astype(np.uint64)) & np.uint64(self.mask)).astype(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of the keys, -1 where there is none."""
        at = self._slot(keys)
        held = self.keys[at]
        out = np.where(held == keys, self.values[at], np.int32(-1))
        todo = np.flatnonzero((held != keys) & (held >= 0))
        at = at[todo]
        while len(todo):
            at = at + 1 & self.mask
            held = self.keys[at]
            hit = held == keys[todo]
            out[todo[hit]] = self.values[at[hit]]
            on = ~hit & (held >= 0)
            todo, at = todo[on], at[on]
        return out


class Pieces:
    """The vocabulary of a SentencePiece model and its segmentation.

    The lattice has an edge for each piece of the vocabulary that matches and for each character that
    starts none. Pieces of a unigram model add their scores. A BPE model has no additive score; its
    segmentation is the one path whose neighbouring pieces are all compatible, i.e. pairs that merging
    in order of rank leaves as they are: an edge costs nothing after a compatible piece and is
    forbidden after any other. Either way one backpointer per position is enough.

    Texts pass as they are, with a space mark put before them: models whose normaliser does more are refused.
    """

    def __init__(self, model: bytes):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_proto=model)
        spec, norm = _spec(model)
        if norm.get(1, b"identity") not in (b"identity", b"") or norm.get(2) or not norm.get(3, 1) or norm.get(4, 1) or not norm.get(5, 1) or spec.get(24):
            raise ValueError("only models that neither normalise texts nor strip spaces, and that put a space mark before a text, are supported")
        self.pieces = [sp.id_to_piece(i) for i in range(sp.get_piece_size())]
        special = [sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i) or sp.is_byte(i) for i in range(len(self.pieces))]
        self.ids = {p: i for i, p in enumerate(self.pieces) if not special[i]}
        self.scores = [sp.get_score(i) for i in range(len(self.pieces))]
        self.byte = {int(p[3:5], 16): i for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.unknown = sp.unk_id()
        self.unigram = spec.get(3, 1) == 1
        self.longest = max(map(len, self.ids))
        self.tails = {p[k:] for p in self.ids for k in range(len(p))}  # no piece ends in anything else
        self.low = min((self.scores[i] for i in self.ids.values()), default=0.0) - 10.0
        # No piece runs over these places, so every path meets there: before the first space mark of a run.
        self.cuts = not any(SPACE in p.lstrip(SPACE) for p in self.ids)
        raw = [p.replace(SPACE, " ").encode("utf-8", "surrogatepass") for p in self.pieces]
        for b, i in self.byte.items():
            raw[i] = bytes([b])
        self.raw = raw
        if not self.unigram:
            self._tabulate()
        self.forget()

    def forget(self) -> None:
        """Frees what was remembered: a worker goes on to other stages, which need the memory."""
        self._known: dict[str, bytes] = {}
        self._older: dict[str, bytes] = {}
        self._merged: dict[tuple[str, str], bool] = {}
        self._pairs = self._fits = None

    # -- which pairs of pieces BPE leaves alone --

    def _merge(self, text: str, parts_left: int = 1) -> list[str]:
        """BPE of a short string: merges the neighbours whose union has the best score, the first of equals."""
        parts = list(text)
        while len(parts) > parts_left:
            best = max(((self.scores[i], -k) for k in range(len(parts) - 1) if (i := self.ids.get(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = -best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def compatible(self, a: str, b: str) -> bool:
        found = self._merged.get((a, b))
        if found is None:
            if len(self._merged) > 50_000:
                self._merged.clear()
            found = self._merged[a, b] = self._merge(a + b) == ([a, b] if a else [b])
        return found

    def _tabulate(self) -> None:
        """Arrays for segmenting many strings at once: a trie of the pieces read backwards, and how each piece is merged."""
        letters = sorted({c for p in self.ids for c in p})
        self.letters = np.array([ord(c) for c in letters], np.int64)
        # characters inside pieces that are no pieces themselves get numbers after the last id
        self.names = self.pieces + [c for c in letters if c not in self.ids]
        number = {**{c: len(self.pieces) + k for k, c in enumerate(self.names[len(self.pieces) :])}, **self.ids}
        n = self.n = len(self.names)
        nodes, keys, child = {"": 0}, [], []
        for tail in sorted(self.tails, key=len):
            nodes[tail] = len(nodes)
            keys.append(nodes[tail[1:]] * len(letters) + int(np.searchsorted(self.letters, ord(tail[0]))))
            child.append(nodes[tail])
        self.trie = Table(np.array(keys, np.int64), np.array(child, np.int32))
        self.piece_at = np.full(len(nodes), -1, np.int32)
        for p, i in number.items():
            self.piece_at[nodes[p]] = i
        # order[i]: when a piece is merged, -1 for a character; left and right: of what
        self.order = np.full(n, -1, np.int64)
        multi = sorted((i for p, i in self.ids.items() if len(p) > 1), key=lambda i: -self.scores[i])
        same = {s: k for k, s in enumerate(sorted({self.scores[i] for i in multi}, reverse=True))}
        self.order[multi] = [same[self.scores[i]] for i in multi]
        self.left, self.right = np.full(n, -1, np.int32), np.full(n, -1, np.int32)
        # pieces that are merged out of order, or not at all, are left to `compatible`, and so are pieces of equal scores
        self.odd = np.zeros(n, bool)
        times = np.bincount(self.order[multi], minlength=1)
        self.odd[multi] = times[self.order[multi]] > 1
        for i in multi:
            parts = self._merge(self.pieces[i], 2)
            if len(parts) == 2 and all(x in number for x in parts):
                self.left[i], self.right[i] = (number[x] for x in parts)
                self.odd[i] |= self.order[self.left[i]] >= self.order[i] or self.order[self.right[i]] >= self.order[i]
            else:
                self.odd[i] = True
        for _ in range(self.longest):
            for part in (self.left, self.right):
                self.odd |= (part >= 0) & self.odd[part]
        pairs = [(number[p[:k]] * n + number[p[k:]], i) for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number]
        self.joins = Table(np.array([k for k, _ in pairs], np.int64), np.array([i for _, i in pairs], np.int32))

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves pieces a, b as neighbours: undoes their merges, the latest first, and looks
        for a pair at the seam that would have been merged before that. Of equal merges the left one comes first."""
        ok = np.ones(len(a), bool)
        for k in np.flatnonzero(self.odd[a] | self.odd[b]):
            ok[k] = self.compatible(self.names[a[k]], self.names[b[k]])
        at = np.flatnonzero(~(self.odd[a] | self.odd[b]))
        x, y, limit, on_right = a[at], b[at], np.full(len(at), 1 << 60), np.zeros(len(at), bool)
        while len(at):
            join = self.joins.get(x.astype(np.int64) * self.n + y)
            when = self.order[join]
            bad = (join >= 0) & ((when < limit) | (when == limit) & on_right)
            ok[at[bad]] = False
            left, right = self.order[x], self.order[y]
            on = ~bad & ((left >= 0) | (right >= 0))
            at, x, y, left, right = at[on], x[on], y[on], left[on], right[on]
            on_right = left <= right
            limit = np.where(on_right, right, left)
            x, y = np.where(on_right, x, self.right[x]), np.where(on_right, self.left[y], y)
        return ok

    def _compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """`_apart`, remembered in a memory of fixed size. Nothing (-2) and unknown characters (-1) fit any neighbour."""
        out = np.ones(len(a), bool)
        at = np.flatnonzero((a >= 0) & (b >= 0))
        if self._pairs is None:
            self._pairs, self._fits = np.full(PAIRS, -1, np.int64), np.zeros(PAIRS, bool)
        key = a[at].astype(np.int64) * self.n + b[at]
        slot = (mix(key.astype(np.uint64)) & np.uint64(PAIRS - 1)).astype(np.int64)
        out[at] = self._fits[slot]
        new = np.flatnonzero(self._pairs[slot] != key)
        if len(new):
            found = self._apart(a[at[new]], b[at[new]])
            out[at[new]] = found
            self._pairs[slot[new]] = key[new]
            # of pairs that fall into one slot the last stays, with its own answer
            self._fits[slot[new]] = found
        return out

    # -- the streaming pass --

    def segment(self, text: str):
        """Pieces of a normalised text, in order, committed as soon as all surviving paths agree.

        Keeps the last `longest` positions alive; whatever backpointer chains share before them is
        committed and forgotten, so memory follows the window and the stretch still in doubt.
        """
        n, longest, ids, tails = len(text), self.longest, self.ids, self.tails
        back: dict[int, tuple[int, float]] = {0: (0, 0.0)}  # position: start of the piece that ends here, cost
        done = 0
        for i in range(1, n + 1):
            best = None
            for j in range(i - 1, max(done, i - longest) - 1, -1):
                piece = text[j:i]
                if piece not in tails and i - j > 1:
                    break
                state = back.get(j)
                if state is None:
                    continue
                known = ids.get(piece)
                if known is None and i - j > 1:
                    continue
                if self.unigram:
                    score = state[1] + (self.scores[known] if known is not None else self.low)
                    if best is None or score > best[1]:
                        best = (j, score)
                elif self.compatible(text[state[0] : j], piece):
                    best = (j, 0.0)
                    break
            if best is not None:
                back[i] = best
            if i - done >= WINDOW * longest or i == n:
                meet, cut = self._meet({p: s[0] for p, s in back.items()}, done, i, n)
                yield from (text[p:q] for p, q in zip(cut, cut[1:]))
                kept = back[meet]
                back = {p: s for p, s in back.items() if p >= meet}
                back[meet] = kept
                done = meet

    def _meet(self, back: dict[int, int], done: int, i: int, n: int) -> tuple[int, list[int]]:
        """Where all paths to the last positions up to i meet, and the bounds of the pieces from `done` to there."""
        alive = {n} if i == n else {p for p in range(max(done, i - self.longest + 1), i + 1) if p in back}
        while len(alive) > 1:
            last = max(alive)
            alive.remove(last)
            alive.add(back[last] if last > done else done)
        cut = [alive.pop()]
        meet = cut[0]
        while cut[-1] > done:
            cut.append(back[cut[-1]])
        return meet, cut[::-1]

    def _advance(self, codes: np.ndarray, length: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """One window of the pass in many lanes at once, a BPE model's. codes: [lane, place] as letters, -1 for none;
        before: the piece committed last in each lane. Gives the length and the id of the piece that ends at each place."""
        lanes, width = codes.shape
        here = np.arange(width)[None, :] < length[:, None]
        lane, place = np.nonzero(here)
        code = codes[lane, place]
        # edges: pieces that end at a place, by walking the trie backwards
        at, node = np.arange(len(lane)), np.zeros(len(lane), np.int64)
        edges = []
        for l in range(1, self.longest + 1):
            if l > 1:
                on = place[at] >= l - 1
                at, node = at[on], node[on]
            c = codes[lane[at], place[at] - l + 1]
            node = self.trie.get(np.where(c >= 0, node * len(self.letters) + c, 1 << 61)).astype(np.int64)
            if l == 1:
                edges.append((at, np.full(len(at), 1), np.where(node >= 0, self.piece_at[node], -1)))
            else:
                ends = np.flatnonzero(node >= 0)
                ends = ends[self.piece_at[node[ends]] >= 0]
                edges.append((at[ends], np.full(len(ends), l), self.piece_at[node[ends]]))
            on = node >= 0
            at, node = at[on], node[on]
            if not len(at):
                break
        at, size, piece = (np.concatenate(e) for e in zip(*edges))
        order = np.argsort(place[at], kind="stable")
        at, size, piece = at[order], size[order], piece[order]
        lane, place = lane[at], place[at]
        bounds = np.searchsorted(place, np.arange(width + 1))
        back, last = np.zeros((lanes, width + 1), np.int16), np.full((lanes, width + 1), -3, np.int32)  # -3: no path
        last[:, 0] = before
        for k in range(width):
            some = slice(bounds[k], bounds[k + 1])
            i, l, p = lane[some], size[some], piece[some]
            left = last[i, k + 1 - l]
            ok = np.flatnonzero(left != -3)
            ok = ok[self._compatible(left[ok], p[ok])]
            back[i[ok], k + 1], last[i[ok], k + 1] = l[ok], p[ok]
        return back, last

    def _settle(self, segments: list[str]) -> list[bytes]:
        """Ids of many strings as int32, by the streaming pass in as many lanes: a window at a time, each lane committing
        where its surviving paths meet; what is in doubt opens the next window. The last few lanes go on alone."""
        if self.unigram:
            return [self._numbered(self.segment(x)) for x in segments]
        out: list[list[bytes]] = [[] for _ in segments]
        lanes, start, before = np.arange(len(segments)), np.zeros(len(segments), np.int64), np.full(len(segments), -2, np.int32)
        width = WINDOW * self.longest
        while len(lanes):
            if len(lanes) < LANES:
                for k, a, b in zip(lanes, start, before):
                    led = self.names[b] if b >= 0 else ""  # the piece before is the first one again
                    pieces = self.segment(led + segments[k][a:])
                    out[k].append(self._numbered(islice(pieces, int(bool(led)), None)))
                break
            texts = [segments[k][a : a + width] for k, a in zip(lanes.tolist(), start.tolist())]
            length = np.fromiter(map(len, texts), np.int64, len(texts))
            if int(length.max()) < width and not start.any():  # all end in this window
                return self._walk(*self._advance(self._letters(texts, length), length, before), length, texts)
            ends = start + length == [len(segments[k]) for k in lanes]
            back, last = self._advance(self._letters(texts, length), length, before)
            # lanes that end walk back from there, all at once; the others to where their paths meet
            done = np.flatnonzero(ends)
            for k, ids in zip(done.tolist(), self._walk(back[done], last[done], length[done], [texts[k] for k in done.tolist()])):
                out[lanes[k]].append(ids)
            for k in np.flatnonzero(~ends).tolist():
                b = {p: p - int(back[k, p]) for p in range(1, int(length[k]) + 1) if last[k, p] != -3}
                meet, cut = self._meet({0: 0, **b}, 0, int(length[k]), -1)
                if not meet:  # nothing is sure within this window: a longer stretch is needed, alone
                    out[lanes[k]] = [self._numbered(self.segment(segments[lanes[k]]))]
                    ends[k] = True
                    continue
                out[lanes[k]].append(b"".join(self._id(int(last[k, q]), texts[k][q - 1]) for q in cut[1:]))
                start[k] += meet
                before[k] = last[k, meet]
            lanes, start, before = lanes[~ends], start[~ends], before[~ends]
        return [b"".join(x) for x in out]

    def _letters(self, texts: list[str], length: np.ndarray) -> np.ndarray:
        raw = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        spot = np.minimum(np.searchsorted(self.letters, raw), len(self.letters) - 1)
        codes = np.full((len(texts), int(length.max())), -1, np.int64)
        codes[np.arange(codes.shape[1])[None, :] < length[:, None]] = np.where(self.letters[spot] == raw, spot, -1)
        return codes

    def _walk(self, back: np.ndarray, last: np.ndarray, length: np.ndarray, texts: list[str]) -> list[bytes]:
        lanes, at, found = np.arange(len(back)), length.astype(np.int64), []
        while len(lanes):
            found.append((lanes, at, last[lanes, at]))
            at = at - back[lanes, at]
            on = at > 0
            lanes, at = lanes[on], at[on]
        if not found:
            return []
        lanes, at, ids = (np.concatenate(x) for x in zip(*found))
        order = np.lexsort((at, lanes))
        lanes, at, ids = lanes[order], at[order], ids[order]
        bounds = np.searchsorted(lanes, np.arange(len(back) + 1)).tolist()
        raw, odd = ids.astype(np.int32).tobytes(), np.flatnonzero((ids < 0) | (ids >= len(self.pieces)))
        out = [raw[4 * a : 4 * b] for a, b in zip(bounds, bounds[1:])]
        for k in np.unique(lanes[odd]).tolist():
            out[k] = b"".join(self._id(int(i), texts[k][q - 1]) for i, q in zip(ids[bounds[k] : bounds[k + 1]], at[bounds[k] : bounds[k + 1]]))
        return out

    def _id(self, piece: int, char: str) -> bytes:
        """A piece as int32; a character that is none as its bytes, or as unknown."""
        if 0 <= piece < len(self.pieces):
            return piece.to_bytes(4, "little")
        return np.array([self.byte[b] for b in char.encode("utf-8", "surrogatepass")] if self.byte else [self.unknown], np.int32).tobytes()

    def _numbered(self, pieces) -> bytes:
        return b"".join(self._id(self.ids.get(p, -1), p) for p in pieces)

    def normalise(self, text: str) -> str:
        return SPACE + text.replace(" ", SPACE) if text else ""

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as int32, nothing for null. Segments between certain cuts that were met before are looked up.

        Without byte pieces, neighbouring unknown characters are one unknown piece.
        """
        split = _SEGMENTS.findall if self.cuts else lambda t: [t] if t else []
        parts = [split(self.normalise(t)) if t else [] for t in texts]
        known, older = self._known, self._older
        new = {x for p in parts for x in p}.difference(known)
        for x in new.intersection(older):
            known[x] = older[x]
        new = sorted(new.difference(older), key=len)
        long, at = {}, 0
        while at < len(new):
            end, chars = at, 0
            while end < len(new) and (end == at or chars + len(new[end]) <= TOGETHER):
                chars += len(new[end])
                end += 1
            for x, ids in zip(new[at:end], self._settle(new[at:end])):
                (known if len(x) <= SHORT else long)[x] = ids
            at = end
        if long:
            out = [b"".join([known.get(x) or long.get(x, b"") for x in p]) for p in parts]
        else:
            out = [b"".join(map(known.__getitem__, p)) for p in parts]
        if len(known) > REMEMBERED:  # what is in use moves on to the next generation, the rest goes
            self._known, self._older = {}, known
        return out if self.byte else [self._one_unknown(x) for x in out]

    def _one_unknown(self, raw: bytes) -> bytes:
        ids = np.frombuffer(raw, np.int32)
        again = np.zeros(len(ids), bool)
        again[1:] = (ids[1:] == self.unknown) & (ids[:-1] == self.unknown)
        return ids[~again].tobytes()

    def encode(self, text: str) -> list[int]:
        return np.frombuffer(self.encode_many([text])[0], np.int32).tolist()

    def decode(self, ids) -> str:
        """The text of ids; runs of byte pieces are read as UTF-8, and the mark put before the text goes."""
        text = b"".join(map(self.raw.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


_SEGMENTS = re.compile(f"{SPACE}*[^{SPACE}]+|{SPACE}+")


def _fields(data: bytes) -> dict[int, int | bytes]:
    """The last value of each field of a message in the model file."""
    out, at = {}, 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            out[tag >> 3] = number()
        else:
            size = number() if tag & 7 == 2 else 8 if tag & 7 == 1 else 4
            out[tag >> 3] = data[at : at + size]
            at += size
    return out


def _spec(model: bytes) -> tuple[dict, dict]:
    """The trainer's settings (3: model type, 1 unigram, 2 BPE; 24: white space as suffix) and the normaliser's (1: name,
    2: rules, 3: a space mark before the text, 4: strip spaces, 5: mark spaces)."""
    top = _fields(model)
    return _fields(top.get(2, b"")), _fields(top.get(3, b""))


def read_model(spark: SparkSession, path: str = MODEL):
    """The vocabulary, read and tabulated once on the driver and broadcast: it is of fixed size."""
    short_batches(spark)
    with open(path, "rb") as f:
        return spark.sparkContext.broadcast(Pieces(f.read()))


def encode_documents(documents: DataFrame, path: str = MODEL, keep: list[str] | None = None, text_col: str = "text") -> DataFrame:
    """The columns in `keep` (all but the text, if not given) and ids array<int>, n_pieces long, round_trip boolean.

    Row by row over whole texts, without a shuffle. Null texts have null ids, empty ones none. round_trip:
    decoding gives the text back; false only for texts that hold the space mark itself (U+2581) or bytes
    that are not UTF-8. Clashing names: the three new columns replace columns of the same name.
    """
    new = ("ids", "n_pieces", "round_trip")
    keep = [c for c in (keep if keep is not None else documents.columns) if c not in (text_col, *new)]
    model = read_model(documents.sparkSession, path)
    inner = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    schema = "".join(f"`{c}` {f.dataType.simpleString()}, " for c, f in zip(keep, inner.schema.fields))

    def run(batches):
        p = model.value
        for whole in batches:
            for batch in (whole.slice(i, 256) for i in range(0, len(whole), 256)):
                texts = batch.column(len(keep)).to_pylist()
                raw = p.encode_many(texts)
                same = pa.array([None if t is None else p.decode(np.frombuffer(i, np.int32).tolist()) == t for t, i in zip(texts, raw)], pa.bool_())
                counts = np.array([len(i) // 4 for i in raw], np.int64)
                offsets = pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32), mask=np.array([t is None for t in texts] + [False]))
                ids = pa.ListArray.from_arrays(offsets, pa.array(np.frombuffer(b"".join(raw), np.int32)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], ids, pa.array(counts), same], [*keep, *new])
        p.forget()

    return inner.mapInArrow(frugal(run), f"{schema}ids array<int>, n_pieces long, round_trip boolean")


def decode_ids(encoded: DataFrame, path: str = MODEL, ids_col: str = "ids", out_col: str = "text") -> DataFrame:
    """Adds the decoded text; null ids give a null text."""
    model = read_model(encoded.sparkSession, path)

    @F.pandas_udf("string")
    def decode(ids):
        import pandas as pd

        p = model.value
        return pd.Series([None if i is None else p.decode(list(i)) for i in ids], dtype=object)

    return encoded.withColumn(out_col, decode(F.col(ids_col)))
