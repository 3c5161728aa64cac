"""Language identification in two steps: the family first, then one-versus-one linear support vector machines within it.

Features are counts of hashed character 1- to 3-grams of the lower-cased text, whatever is no letter counting as one space; their
logarithms are scaled to length 1.  A machine per pair of families votes for the family, a machine per pair of languages of that family votes
for the language; ties go to the larger sum of margins.

The machines are fitted on a bounded sample: ids are dealt to ``BUCKETS`` buckets by their hash, and of each language and bucket at most ``IN_BUCKET`` texts are taken, those with the
least hash of their id.  Every language that occurs is learned.  Each machine is fitted by a task of its own, from the texts of its two sides; only weights come to the driver.

Defined results: ``und`` with score 0 for a null text, a text without letters, or where nothing could be learned (no labelled rows);
with one learned language, that one with score 1; repeated rows are judged each; other columns are ignored.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, quoted, remainder, small_batches, stored

#: Parameters: buckets of ids, texts of a language to learn from at most in each; hashed features, passes, weight of the margin; bytes of ids that may be broadcast.
BUCKETS, IN_BUCKET, DIMENSIONS, PASSES, REGULAR, BROADCAST_BYTES = 50, 6, 1 << 15, 12, 1e-4, 32 << 20

#: Language codes by family; a code that is in none is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "baltic": "lt lv",
    "uralic": "et fi hu",
    "turkic": "az kk ky tr uz",
    "indo-aryan": "bn gu hi mr ne pa ur",
}
_FAMILY = {code: family for family, codes in FAMILIES.items() for code in codes.split()}


def family_of(lang: str) -> str:
    return _FAMILY.get(lang, lang)


_LETTERS: list[np.ndarray] = []


def _folded(text: str) -> tuple[np.ndarray, bool]:
    """Code points of the lower-cased text with a space at either end, 32 for each that is no letter, and whether any is one."""
    if not _LETTERS:
        _LETTERS.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    codes = np.frombuffer(f" {text.lower()} ".encode("utf-32-le"), np.uint32)
    letters = _LETTERS[0][codes]
    return np.where(letters, codes, np.uint32(32)), bool(letters.any())


def features(text: str) -> tuple[np.ndarray, bool]:
    """The scaled feature vector of a whole text, and whether it holds a letter."""
    c, any_letter = _folded(text)
    a, b, d = np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D)
    one = c * a
    two = (one[:-1] ^ c[1:]) * b
    three = (two[:-1] ^ c[2:]) * d
    shift = np.uint32(32 - (DIMENSIONS.bit_length() - 1))
    counts = np.zeros(DIMENSIONS, np.int64)
    for h in (one, two, three):
        # A run of anything but letters says little: features that are all spaces stay, as one bin among many.
        counts += np.bincount((h ^ h >> np.uint32(15)) * a >> shift, minlength=DIMENSIONS)
    x = np.log1p(counts).astype(np.float32)
    return x / max(float(np.sqrt(x @ x)), 1e-9), any_letter


def machine(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray) -> np.ndarray:
    """A linear machine with a margin: averaged stochastic subgradient descent on the hinge loss; rows are (features that are not zero, values), y is -1 or 1."""
    w, mean, t, order = np.zeros(DIMENSIONS), np.zeros(DIMENSIONS), 0, np.random.default_rng(7)
    weight = {s: len(y) / (2 * max(1, (y == s).sum())) for s in (-1, 1)}
    for _ in range(PASSES):
        for i in order.permutation(len(y)):
            t += 1
            rate, (at, x) = 1 / (REGULAR * (t + 1e4 / 4)), rows[i]
            inside = y[i] * (w[at] @ x) < 1
            w *= 1 - rate * REGULAR
            if inside:
                w[at] += rate * weight[y[i]] * y[i] * x
            mean += (w - mean) / t
    return mean.astype(np.float32)


def machine_names(langs: list[str]) -> list[tuple[str, str, str]]:
    """The machines that these languages ask for: ``(family, a, b)`` for languages a and b of a family, and ``("", a, b)`` for families a and b."""
    families: dict[str, list[str]] = {}
    for lang in sorted(set(langs)):
        families.setdefault(family_of(lang), []).append(lang)
    within = [(f, a, b) for f, own in sorted(families.items()) for a, b in itertools.combinations(own, 2)]
    return [("", a, b) for a, b in itertools.combinations(sorted(families), 2)] + within


class Model:
    """Machines for pairs of families and for pairs of languages within each: ``machines`` holds the weights by name (see ``machine_names``).

    Weights travel as 16-bit numbers, 64 kB for each machine.
    """

    def __init__(self, langs: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        self.families: dict[str, list[str]] = {}
        for lang in sorted(set(langs)):
            self.families.setdefault(family_of(lang), []).append(lang)
        self.top = self._pairs("", sorted(self.families), machines)
        self.within = {f: self._pairs(f, own, machines) for f, own in self.families.items()}

    @staticmethod
    def _pairs(step: str, names: list[str], machines: dict[tuple[str, str, str], np.ndarray]):
        pairs = [*itertools.combinations(range(len(names)), 2)]
        rows = [machines[step, names[i], names[j]] for i, j in pairs]
        return names, pairs, np.array(rows, np.float16).reshape(len(rows), DIMENSIONS)

    @staticmethod
    def _choose(machines, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row the place of the name chosen and the least margin of a machine for it over its rivals."""
        names, pairs, w = machines
        votes, sums, least = (np.zeros((len(x), len(names))) for _ in range(3))
        least += np.inf
        for (i, j), m in zip(pairs, (x @ w.T).T, strict=True):
            for k, margin in ((i, m), (j, -m)):
                votes[:, k] += margin > 0
                sums[:, k] += margin
                least[:, k] = np.minimum(least[:, k], margin)
        best = np.argmax(votes + 1e-3 * np.tanh(sums), axis=1) if len(names) else np.zeros(len(x), int)
        return best, least[np.arange(len(x)), best] if len(names) else np.zeros(len(x))

    def predict(self, x: np.ndarray) -> tuple[list[str], np.ndarray]:
        """The language of each row and a score from 0 to 1: the product of the squashed least margins of both steps."""
        if self.top[2].dtype == np.float16:
            wide = lambda step: (*step[:2], step[2].astype(np.float32))
            self.top, self.within = wide(self.top), {f: wide(step) for f, step in self.within.items()}
        squash = lambda m: 1 / (1 + np.exp(-np.clip(6 * m, -30, 30)))
        best, margin = self._choose(self.top, x)
        out, score = [""] * len(x), squash(margin)
        for f, name in enumerate(self.top[0]):
            rows = np.flatnonzero(best == f)
            if len(rows):
                inner, margin = self._choose(self.within[name], x[rows])
                score[rows] *= squash(margin)
                for r, k in zip(rows, inner, strict=True):
                    out[r] = self.families[name][k]
        return out, score


def sample(docs: DataFrame, learn_from: Column, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """``lang, id, content``: the texts to learn from, one for each id and language (the least text where an id repeats)."""
    lang, key = F.col(quoted(lang_col)), F.col(quoted(id_col)).cast("string")
    known = docs.where(learn_from & lang.isNotNull() & F.col(quoted(text_col)).isNotNull() & key.isNotNull())
    place = F.xxhash64("id")
    # A language that most rows have is dealt to BUCKETS tasks, and no more than IN_BUCKET ids of a bucket leave each task before.
    order = Window.partitionBy("lang", "bucket").orderBy(place, "id")
    ids = known.select(key.alias("id"), lang.alias("lang")).distinct().withColumn("bucket", F.pmod(F.xxhash64("id", F.lit("bucket")), F.lit(BUCKETS)))
    chosen = checkpointed(ids.withColumn("n", F.row_number().over(order)).where(F.col("n") <= IN_BUCKET).select("id", "lang"))
    if (chosen.agg(F.sum(F.octet_length("id") + F.octet_length("lang") + 48)).first()[0] or 0) <= BROADCAST_BYTES:
        chosen = F.broadcast(chosen)
    texts = known.select(key.alias("id"), lang.alias("lang"), F.col(quoted(text_col)).alias("content")).join(chosen, ["id", "lang"], "left_semi")
    return texts.groupBy("lang", "id").agg(F.min("content").alias("content"))


def fit(docs: DataFrame, learn_from: Column, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model | None:
    """Fits the machines on rows of ``docs`` where ``learn_from`` holds and the language is known; None if there are none."""

    small_batches(docs.sparkSession)

    def featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for lang, key, text in zip(*(batch.column(i).to_pylist() for i in range(3)), strict=True):
                x, any_letter = features(text)
                if any_letter:
                    on = np.flatnonzero(x)
                    yield pa.RecordBatch.from_pydict({"lang": [lang], "id": [key], "at": [on.astype("<u2").tobytes()], "x": [x[on].astype("<f4").tobytes()]})

    rows = stored(sample(docs, learn_from, id_col, text_col, lang_col).mapInArrow(featured, "lang string, id string, at binary, x binary"), "language-sample")
    langs = sorted(r["lang"] for r in rows.select("lang").distinct().collect())
    if not langs:
        return None
    names = machine_names(langs)
    # Each side of a machine as rows (machine, language, label), so that texts meet their machines in a join.
    sides = [(n, lang, y) for n, (step, a, b) in enumerate(names) for lang in langs for y, side in ((1, a), (-1, b)) if (lang == side if step else family_of(lang) == side)]

    def train(part: pa.Table) -> pa.Table:
        part = part.sort_by([("lang", "ascending"), ("id", "ascending")])
        found = [(np.frombuffer(at, "<u2").astype(np.int64), np.frombuffer(x, "<f4")) for at, x in zip(part.column("at").to_pylist(), part.column("x").to_pylist(), strict=True)]
        return pa.table({"machine": part.column("machine").slice(0, 1), "w": [machine(found, part.column("y").to_numpy()).astype("<f2").tobytes()]})

    fitted = []
    if sides:
        of = docs.sparkSession.createDataFrame(sides, "machine int, lang string, y int")
        fitted = rows.join(F.broadcast(of), "lang").repartition(len(names), "machine").groupBy("machine").applyInArrow(train, "machine int, w binary").collect()
    return Model(langs, {names[r["machine"]]: np.frombuffer(r["w"], "<f2") for r in fitted})


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), named: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``doc_id`` (and the columns in ``keep``), and the language and its score in columns ``named`` so, for each row of ``docs``."""
    small_batches(docs.sparkSession)
    shown = [*dict.fromkeys((id_col, *keep))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                lang, score = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
                found = [(i, x) for i, text in enumerate(batch.column(batch.num_columns - 1).to_pylist()) if text and model for x, any_letter in [features(text)] if any_letter]
                if found:
                    got, sure = model.predict(np.array([x for _, x in found]))
                    for (i, _), g, s in zip(found, got, sure, strict=True):
                        lang[i], score[i] = g, s
                yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(lang, pa.string()), pa.array(score)], [*shown, *named])

    schema = docs.select([F.col(quoted(n)) for n in shown]).schema.add(named[0], "string").add(named[1], "double")
    return docs.select(*[F.col(quoted(n)) for n in shown], F.col(quoted(text_col)).alias(fresh("_content", shown))).mapInArrow(run, schema)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Learns from rows whose crc32 of the id modulo 5 is not 0 and judges all: ``doc_id, held_out, lang_pred, score``."""
    model = fit(docs, remainder(id_col, 5) != 0, id_col, text_col, lang_col)
    return predict(docs, model, id_col, text_col).select(F.col(quoted(id_col)).alias("doc_id"), (remainder(id_col, 5) == 0).alias("held_out"), "lang_pred", "score")
