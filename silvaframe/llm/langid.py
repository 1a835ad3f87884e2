"""Language ID: string kernels with Nystrom landmarks and one-versus-rest kernel ridge regression."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Scratch, frugal


#: Longest n-gram; landmarks and training texts of a language, about; landmarks of all languages, about, but one of each at
#: least; characters of a landmark, a window from the text's start; n-grams that are multiplied together.
ORDER, LANDMARKS, TRAIN, ALL_LANDMARKS, LANDMARK_CHARS, SLICE = 3, 48, 1500, 512, 2_000, 1 << 14
UNKNOWN = "und"
#: Languages that are learned at most: the model and what is collected for it grow with them.
LANGUAGES = 1000
_CHUNK = 1 << 20


def _codes(text: str) -> np.ndarray:
    """Code points of the lower-cased text, everything but letters made a space, runs of spaces one."""
    raw = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kinds, back = np.unique(raw, return_inverse=True) if len(raw) > 4096 else (None, None)
    if kinds is None:
        letters = np.fromiter(map(str.isalpha, text.lower()), bool, len(raw))
    else:
        letters = np.array([chr(c).isalpha() for c in kinds])[back]
    out = np.where(letters, raw, 32)
    keep = np.ones(len(out), bool)
    keep[1:] = letters[1:] | letters[:-1]
    return np.concatenate([[32], out[keep], [32]]).astype(np.int64)


def spectrum(text: str) -> np.ndarray:
    """The sorted set of all n-grams of 1 to 3 characters, as 63-bit codes; long texts in overlapping chunks."""
    c = _codes(text)
    parts = []
    for at in range(0, len(c), _CHUNK):
        x = c[at : at + _CHUNK + ORDER - 1]
        grams, code = [], np.zeros(len(x), np.int64)
        for n in range(ORDER):
            code = (code[: len(x) - n] << 21) | (x[n:] + 1)
            grams.append(code)
        parts.append(np.unique(np.concatenate(grams)))
    return parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))


@dataclass
class Model:
    """K(x, landmarks) @ weights scores the languages; the kernel is |A n B| / sqrt(|A| |B|) on n-gram sets.

    The landmarks' incidence is kept as lists: the landmarks of n-gram k are owner[first[k]:first[k + 1]]. It is
    multiplied in slices of n-grams, so memory does not follow the landmarks' lengths.
    """

    languages: list[str]
    grams: np.ndarray
    first: np.ndarray
    owner: np.ndarray
    scale: np.ndarray  # of a landmark: 1 / sqrt(size)
    scores: np.ndarray | None = None  # n-grams x languages: incidence @ weights

    @classmethod
    def of(cls, languages: list[str], sets: list[np.ndarray]) -> "Model":
        every, owner = np.concatenate(sets), np.repeat(np.arange(len(sets), dtype=np.int32), [len(s) for s in sets])
        order = np.argsort(every, kind="stable")
        grams, first = np.unique(every[order], return_index=True)
        return cls(languages, grams, np.append(first, len(every)), owner[order], np.array([1 / np.sqrt(len(s)) for s in sets]))

    def incidence(self, a: int, b: int) -> np.ndarray:
        """n-grams a..b x landmarks: presence / sqrt(size of the landmark)."""
        out = np.zeros((b - a, len(self.scale)), np.float32)
        rows = np.repeat(np.arange(b - a), np.diff(self.first[a : b + 1]))
        owner = self.owner[self.first[a] : self.first[b]]
        out[rows, owner] = self.scale[owner]
        return out

    def learn(self, weights: np.ndarray) -> None:
        self.scores = np.concatenate([self.incidence(a, min(a + SLICE, len(self.grams))) @ weights.astype(np.float32) for a in range(0, len(self.grams), SLICE)])

    def _product(self, sets: list[np.ndarray], columns, width: int) -> np.ndarray:
        """Presence / sqrt(size) of the sets' n-grams, multiplied by columns(a, b) of each slice a..b."""
        out = np.zeros((len(sets), width), np.float32)
        for i in range(0, len(sets), 256):
            part = sets[i : i + 256]
            row = np.repeat(np.arange(len(part)), [len(s) for s in part])
            every = np.concatenate(part)
            at = np.minimum(np.searchsorted(self.grams, every), len(self.grams) - 1)
            hit = self.grams[at] == every
            row, at, value = row[hit], at[hit], np.repeat([1 / np.sqrt(len(s)) for s in part], [len(s) for s in part])[hit]
            for a in range(0, len(self.grams), SLICE):
                b = min(a + SLICE, len(self.grams))
                here = np.zeros((len(part), b - a), np.float32)
                some = (at >= a) & (at < b)
                here[row[some], at[some] - a] = value[some]
                out[i : i + 256] += here @ columns(a, b)
        return out

    def kernel(self, sets: list[np.ndarray]) -> np.ndarray:
        return self._product(sets, self.incidence, len(self.scale))

    def values(self, texts: list[str]) -> np.ndarray:
        """A regression value for each language."""
        return self._product([spectrum(t) for t in texts], lambda a, b: self.scores[a:b], len(self.languages))


def train(documents: DataFrame, labelled: Column, seed: int = 0, ridge: float = 1e-3, text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits on a bounded sample of the rows where `labelled` holds; None without any that has a language and letters.

    Every language is learned; of each about TRAIN different texts, of which about LANDMARKS (fewer with many
    languages, one at least) are landmarks, each cut to a window of LANDMARK_CHARS characters. Texts are drawn by a
    hash of the text, as a share of the language's different texts: ids do not matter, whether null or repeated, and
    copies count once. A language of which none is drawn gives its first text in the order of hashes. More than LANGUAGES
    different values are refused.
    The sample's kernel rows stay on the executors: each partition adds up its normal equations, and only
    those sums, of the landmarks' size, come together.
    """
    letters = F.col("text").rlike(r"\p{L}")
    docs = documents.where(labelled).select(F.col(text_col).cast("string").alias("text"), F.col(lang_col).cast("string").alias("lang"))
    docs = docs.where(F.col("lang").isNotNull() & (F.col("lang") != UNKNOWN)).where(letters).withColumn("hash", F.xxhash64(F.lit(seed), "text"))
    counts = docs.groupBy("lang").agg(F.approx_count_distinct("hash", 0.02).alias("n")).limit(LANGUAGES + 1).collect()
    if not counts:
        return None
    if len(counts) > LANGUAGES:
        raise ValueError(f"more than {LANGUAGES} different values in {lang_col}: these are hardly languages, and none is left out in silence")
    languages = sorted(r.lang for r in counts)
    n = F.create_map(*[F.lit(x) for r in counts for x in (r.lang, float(r.n))])[F.col("lang")]
    # a uniform number of each text in [0, 1), times the number of texts: those under k are about k texts
    place = docs.withColumn("place", F.pmod("hash", F.lit(1 << 30)) / float(1 << 30) * n)
    scratch = Scratch(documents.sparkSession, "langid")
    few = place.where(F.col("place") < TRAIN).dropDuplicates(["lang", "hash"]).select("lang", "text", "place")
    chosen = scratch.save(few.repartition(16))
    got = {r.lang for r in chosen.select("lang").distinct().collect()}
    if len(got) < len(languages):
        rest = place.where(F.col("lang").isin([x for x in languages if x not in got]))
        chosen = chosen.unionByName(scratch.save(rest.groupBy("lang").agg(F.min(F.struct("place", "text")).alias("m")).select("lang", "m.text", "m.place")))
    each = min(LANDMARKS, max(1, ALL_LANDMARKS // len(languages)))
    cut = F.substring("text", 1, LANDMARK_CHARS)
    # the first of a language is a landmark whatever its place
    least = chosen.groupBy("lang").agg(F.min("place").alias("least"))
    marks = chosen.join(F.broadcast(least), "lang").where((F.col("place") < each) | (F.col("place") == F.col("least"))).select("lang", F.when(cut.rlike(r"\p{L}"), cut).otherwise(F.regexp_extract("text", rf"(?s)\p{{L}}.{{0,{LANDMARK_CHARS}}}", 0)).alias("text"))
    model = Model.of(languages, [spectrum(r.text) for r in sorted(marks.collect())])
    size = len(model.scale)
    shared = documents.sparkSession.sparkContext.broadcast(model)  # LANDMARKS windows a language: bounded

    def sums(batches):
        m = shared.value
        a, b = np.zeros((size, size)), np.zeros((size, len(m.languages)))
        for batch in batches:
            lang = batch.column(0).to_pylist()
            texts = batch.column(1).to_pylist()
            for i in range(0, len(texts), 64):
                k = m.kernel([spectrum(t) for t in texts[i : i + 64]]).astype(np.float64)
                y = np.array([[float(x == one) for one in m.languages] for x in lang[i : i + 64]]).reshape(len(k), -1)
                # each language weighs the same, however few rows it has
                w = np.array([1.0 / weight[x] for x in lang[i : i + 64]])[:, None]
                a += k.T @ (w * k)
                b += k.T @ (w * y)
        yield pa.RecordBatch.from_arrays([pa.array([a.tobytes()]), pa.array([b.tobytes()])], ["a", "b"])

    weight = {r.lang: max(1.0, min(float(r.n), TRAIN)) for r in counts}
    a, b = np.zeros((size, size)), np.zeros((size, len(languages)))
    for r in chosen.select("lang", "text").mapInArrow(frugal(sums), "a binary, b binary").toLocalIterator():  # sums of at most 17 tasks, each landmarks x landmarks
        a += np.frombuffer(r.a).reshape(a.shape)
        b += np.frombuffer(r.b).reshape(b.shape)
    # Nystrom: min over w of |K w - y|^2 + ridge w' K_mm w
    k_mm = np.zeros((size, size))
    for at in range(0, len(model.grams), SLICE):
        part = model.incidence(at, min(at + SLICE, len(model.grams))).astype(np.float64)
        k_mm += part.T @ part
    model.learn(np.linalg.solve(a + ridge * k_mm + 1e-9 * np.eye(size), b))
    shared.destroy()
    return model


def classify(documents: DataFrame, model: Model | None, keep: list[str], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score to the columns in `keep`, row by row over whole texts.

    lang_pred is und, with score 0, for a null text, a text without letters, or without a model. score:
    the winner's regression value, cut to 0..1; near 0 for a text unlike all landmarks. Ties go to the first language by name.
    """
    shared = documents.sparkSession.sparkContext.broadcast(model)
    inner = documents.select(*[F.col(f"`{c}`").alias(f"c{k}") for k, c in enumerate(keep)], F.col(text_col).cast("string").alias("text"))
    schema = ", ".join(f"`{c}` {f.dataType.simpleString()}" for c, f in zip(keep, inner.schema.fields))

    def run(batches):
        m = shared.value
        for whole in batches:
            for batch in (whole.slice(i, 512) for i in range(0, len(whole), 512)):
                texts = batch.column(len(keep)).to_pylist()
                pred, score = [UNKNOWN] * len(texts), np.zeros(len(texts))
                known = [i for i, t in enumerate(texts) if t and any(map(str.isalpha, t))] if m else []
                if known:
                    values = m.values([texts[i] for i in known])
                    best = values.argmax(axis=1)
                    for i, b, v in zip(known, best, values[np.arange(len(best)), best]):
                        pred[i], score[i] = m.languages[b], min(1.0, max(0.0, float(v)))
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(pred, pa.string()), pa.array(score, pa.float64())], [*keep, "lang_pred", "score"])

    return inner.mapInArrow(frugal(run), f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that nothing is learned from: crc32 of the id as text, modulo 4, is 2. A null id counts as empty text."""
    return F.crc32(F.encode(F.coalesce(F.col(id_col).cast("string"), F.lit("")), "UTF-8")) % 4 == 2


def identify(documents: DataFrame, seed: int = 0, **cols: str) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), a row per document.

    Learns from text and non-null lang of rows outside the held-out fold; nothing but the text enters a
    prediction. Repeated rows get equal answers; an empty table gives an empty result.
    """
    id_col, text_col = cols.get("id_col", "doc_id"), cols.get("text_col", "text")
    model = train(documents, ~held_out(id_col), seed, **{k: v for k, v in cols.items() if k != "id_col"})
    docs = documents.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    return classify(docs.withColumn("held_out", held_out()), model, ["doc_id", "held_out"])
