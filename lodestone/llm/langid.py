"""Language identification by hierarchical discrimination.

A text becomes frequencies of hashed letter 1- to 3-grams (UTF-8 bytes, letters and word gaps only).  A linear SVM per
language family predicts the family first; within it, one-versus-one linear SVMs for each pair of languages vote.
The models are a matrix of weights, so a prediction is one gather and sum over a whole text's n-grams.

Training takes at most SAMPLE labelled documents of the LANGUAGES commonest languages, shared evenly and drawn by a hash
of doc_id; neither bound grows with the corpus, and rarer labels (mostly typing errors) are not learned.

Nulls and ties: a null text or one without a letter is ``und`` with score 0; so is every text if there is nothing to
learn from.  Rows without lang or doc_id teach nothing; of rows that share a doc_id and a lang, one text teaches.  Very
long texts are read whole, a piece at a time; repeated rows get equal results; an empty table gives an empty result.
Equal votes are settled by the sum of margins, then by name.  Columns named lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import arrow_table, column, pieces, sealed, small_batches, steps, text_bytes
from lodestone.storage import importable

#: Labelled documents that train the models, over all languages.
SAMPLE = 4000
#: Languages that are learned, the commonest first.
LANGUAGES = 100
#: Documents of a lower score have no known language.
LEAST_SCORE = 0.4
BUCKETS = 1 << 12
UNKNOWN = "und"
#: Families of the language codes that corpora commonly carry; any other code is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo fy is lb nb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "celtic": "br cy ga gd",
    "turkic": "az kk ky tr tt uz",
    "indic": "bn gu hi mr ne pa ur",
    "dravidian": "kn ml ta te",
    "semitic": "am ar he mt",
    "malayic": "id jv ms su tl",
    "cjk": "ja ko zh",
}
_FAMILY = {code: name for name, codes in FAMILIES.items() for code in codes.split()}
_M1, _M2, _M3 = 0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D


def family(lang: str) -> str:
    return _FAMILY.get(lang.lower().partition("-")[0].partition("_")[0], lang)


_LETTER = np.arange(256, dtype=np.uint32)
_LETTER[65:91] += 32
_LETTER[[i for i in range(128) if not chr(i).isalpha()]] = 0  # gaps


def ngrams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all 1-, 2- and 3-grams of the texts' letters, three rows of one per byte; and the bytes' rows.

    Bytes that start an n-gram beyond their text's end, or inside a run of gaps, have bucket BUCKETS (weight 0).
    """
    c = _LETTER[data]
    n = len(c)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    out = np.full((3, n), BUCKETS, np.int32)
    shift = np.uint32(32 - BUCKETS.bit_length() + 1)
    letter = c > 0
    h = c * np.uint32(_M1)
    out[0, letter] = ((h * np.uint32(_M2)) >> shift)[letter]
    for k, m in ((1, _M2), (2, _M3)):
        if n <= k:
            break
        h = h[:-1] * np.uint32(_M3) + c[k:] * np.uint32(m)
        same = (row[k:] == row[:-k]) & (letter[: n - k] | letter[1 : n - k + 1])
        mixed = (h ^ (h >> np.uint32(15))) * np.uint32(_M1)
        out[k, : n - k][same] = (mixed >> shift)[same]
    return out, row


def frequencies(texts: pa.Array) -> np.ndarray:
    """One row of n-gram frequencies per text."""
    data, offsets = text_bytes(texts)
    n = len(offsets) - 1
    out = np.zeros((n, BUCKETS), np.float32)
    for i, j in steps(offsets):
        grams, row = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
        for g in grams:
            ok = g < BUCKETS
            out[i:j] += np.bincount(row[ok] * BUCKETS + g[ok], minlength=(j - i) * BUCKETS).reshape(j - i, BUCKETS)
    return out / np.maximum(out.sum(axis=1, keepdims=True), 1)


def svm(x: np.ndarray, rows: np.ndarray, y: np.ndarray, c: float = 1.0, rounds: int = 30, seed: int = 3) -> np.ndarray:
    """Weights (the bias last) of a linear SVM with squared hinge loss on the given rows, by dual coordinate descent; y
    is -1 or 1."""
    w, bias, a = np.zeros(x.shape[1], np.float32), 0.0, np.zeros(len(rows))
    norm, rng = np.einsum("ij,ij->i", x, x)[rows] + 1 + 0.5 / c, np.random.default_rng(seed)
    for _ in range(rounds):
        most = 0.0
        for i in rng.permutation(len(rows)):
            own = x[rows[i]]
            g = y[i] * (float(w @ own) + bias) - 1 + a[i] * 0.5 / c
            step = max(a[i] - g / norm[i], 0.0) - a[i]
            if step:
                w += np.float32(step * y[i]) * own
                bias += step * y[i]
                a[i] += step
                most = max(most, abs(step))
        if most < 1e-4:
            break
    return np.append(w, np.float32(bias))


class Model:
    """Families, languages and one weight column (frequencies scaled, bias apart) per SVM."""

    def __init__(self, x: np.ndarray, langs: list[str]):
        self.langs = sorted(set(langs))
        self.families = sorted({family(v) for v in self.langs})
        self.members = {f: [v for v in self.langs if family(v) == f] for f in self.families}
        mean = np.einsum("ij,ij->j", x, x) / max(1, len(x))
        self.scale = (1 / np.sqrt(mean + 1e-9)).clip(max=1e4).astype(np.float32) / np.float32(np.sqrt(max(1.0, np.count_nonzero(x) / max(1, len(x)))))
        x *= self.scale  # the matrix is the caller's to give: no copy is made of it
        lang = np.array(langs, object)
        fam = np.array([family(v) for v in langs], object)
        columns, self.column = [], {}

        def learn(key, rows: np.ndarray, positive: np.ndarray) -> None:
            self.column[key] = len(columns)
            columns.append(svm(x, rows, np.where(positive, 1.0, -1.0)))

        if len(self.families) > 1:
            for f in self.families:
                learn(f, np.arange(len(x)), fam == f)
        for f in self.families:
            for i, a in enumerate(self.members[f]):
                for b in self.members[f][i + 1 :]:
                    rows = np.flatnonzero((lang == a) | (lang == b))
                    learn((a, b), rows, lang[rows] == a)
        w = np.array(columns, np.float32).reshape(len(columns), BUCKETS + 1)
        self.bias = w[:, -1]
        self.weights = np.concatenate([w[:, :-1] * self.scale, np.zeros((len(columns), 1), np.float32)], axis=1)

    def margins(self, texts: pa.Array) -> np.ndarray:
        """Per text the margin of every SVM."""
        data, offsets = text_bytes(texts)
        out = np.zeros((len(offsets) - 1, len(self.bias)))
        for i, j in steps(offsets):
            grams, row = ngrams(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            used = np.zeros(j - i)
            for g in grams:
                used += np.bincount(row, g < BUCKETS, minlength=j - i)
                for k, w in enumerate(self.weights):
                    out[i:j, k] += np.bincount(row, w[g], minlength=j - i)
            out[i:j] /= np.maximum(used, 1)[:, None]
        return out + self.bias

    def predict(self, texts: pa.Array) -> tuple[list[str], list[float]]:
        """The language of each text, and a score in (0, 1): how clearly family and language won."""
        if not self.langs:
            return [UNKNOWN] * len(texts), [0.0] * len(texts)
        m = self.margins(texts)
        n, sure = len(m), lambda v: 1 / (1 + np.exp(-np.clip(4 * v, -50, 50)))
        if len(self.families) > 1:
            f = m[:, [self.column[x] for x in self.families]]
            chosen = f.argmax(axis=1)
            top = np.sort(f, axis=1)
            score = sure(top[:, -1] - top[:, -2])
        else:
            chosen, score = np.zeros(n, int), np.ones(n)
        langs = np.empty(n, object)
        for i, name in enumerate(self.families):
            at = np.flatnonzero(chosen == i)
            members = self.members[name]
            if not len(at):
                continue
            votes, total, least = (np.zeros((len(at), len(members))) for _ in range(3))
            least += np.inf
            for a in range(len(members)):
                for b in range(a + 1, len(members)):
                    v = m[at, self.column[members[a], members[b]]]
                    for x, own in ((a, v), (b, -v)):
                        votes[:, x] += own > 0
                        total[:, x] += own
                        least[:, x] = np.minimum(least[:, x], own)
            best = (votes + 0.5 * np.tanh(total / max(1, len(members))) * 0.99).argmax(axis=1)
            langs[at] = np.array(members, object)[best]
            if len(members) > 1:
                score[at] *= sure(least[np.arange(len(at)), best])
        return langs.tolist(), score.tolist()


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def train(docs: DataFrame, sample: int = SAMPLE, languages: int = LANGUAGES) -> Model:
    """A model from the labelled documents that are not held out."""
    ids = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang"))
    known = ids.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(languages).collect()}
    if not counts:
        return Model(np.zeros((0, BUCKETS), np.float32), [])
    each = max(1, sample // len(counts))
    place = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / (1 << 30)
    rates = F.create_map(*(F.lit(v) for k, n in counts.items() for v in (k, min(1.0, (1.5 * each + 50) / n))))
    drawn = known.where(place < F.try_element_at(rates, F.col("lang"))).distinct().select("doc_id", "lang", place.alias("place")).collect()  # about 1.5 * sample rows
    picked: dict[str, list[int]] = {}
    for r in sorted(drawn, key=lambda r: (r.place, r.doc_id)):
        if len(own := picked.setdefault(r["lang"], [])) < each:
            own.append(r.doc_id)
    wanted = docs.sparkSession.createDataFrame([(i, v) for v, own in picked.items() for i in own], "wanted long, as_lang string")

    def vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = frequencies(column(b, "text"))
            at = [np.flatnonzero(v) for v in x]
            yield pa.RecordBatch.from_arrays(
                [column(b, "wanted"), column(b, "as_lang"), pa.array([i.astype("<u2").tobytes() for i in at], pa.binary()), pa.array([v[i].astype("<f4").tobytes() for v, i in zip(x, at)], pa.binary())],
                names=["wanted", "as_lang", "at", "x"],
            )

    rows = docs.join(F.broadcast(wanted), (docs.doc_id == wanted.wanted) & (docs.lang == wanted.as_lang)).where("text is not null").select("wanted", "as_lang", "text")
    rows = rows.groupBy("wanted", "as_lang").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # at most ``sample`` rows
    with small_batches(docs.sparkSession):
        table = rows.repartition(4, "wanted").mapInArrow(vectors, "wanted long, as_lang string, at binary, x binary").toArrow()
    table = table.sort_by([("wanted", "ascending"), ("as_lang", "ascending"), ("x", "ascending")])
    x, langs = np.zeros((table.num_rows, BUCKETS), np.float32), table.column("as_lang").to_pylist()
    for r, (at, v) in enumerate(zip(table.column("at").to_pylist(), table.column("x").to_pylist())):
        x[r, np.frombuffer(at, "<u2")] = np.frombuffer(v, "<f4")
    return Model(x, langs)


def judged(model: Model, texts: pa.Array) -> tuple[list[str], list[float]]:
    """The language and score of each text; UNKNOWN and 0 where it has no letter."""
    texts = texts.fill_null("")
    langs, scores = model.predict(texts)
    lettered = pc.match_substring_regex(texts, r"\pL").to_pylist()
    return [v if ok else UNKNOWN for v, ok in zip(langs, lettered)], [v if ok else 0.0 for v, ok in zip(scores, lettered)]


def identify(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """All columns of ``docs`` with lang_pred and score (former ones of these names are replaced); lang, source and doc_id
    play no part in a prediction."""
    importable(docs.sparkSession)
    model = model or train(docs)
    docs = docs.drop("lang_pred", "score")
    names = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            langs, scores = judged(model, b.column(names.index("text")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=[*names, "lang_pred", "score"])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields) + ", lang_pred string, score double"
    return docs.mapInArrow(run, schema)


def known_language(docs: DataFrame, least_score: float = LEAST_SCORE) -> DataFrame:
    """The documents (their own columns) whose language is known: ``und`` ones go, and those where neither the family nor
    the language wins clearly (a score below ``least_score``; two even contests score 0.25).  Where there is nothing to
    learn from, all are ``und`` and go.

    Only the ids and text hashes of what goes come back from Python; no text does.
    """
    rows, names = sealed(docs, "doc_id", "text", "lang")
    model = train(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = judged(model, column(b, "text"))
            gone = pa.array([v == UNKNOWN or s < least_score for v, s in zip(langs, scores)], pa.bool_())
            yield b.select(["_d", "_t"]).filter(gone)

    keyed = rows.select(F.col("doc_id").cast("long").alias("_d"), F.xxhash64("text").alias("_t"), "text")
    gone = arrow_table(keyed, run, "_d long, _t long", "language-unknown").distinct()
    same = rows.doc_id.cast("long").eqNullSafe(F.col("_d")) & (F.xxhash64("text") == F.col("_t"))
    return rows.join(gone, same, "left_anti").select(*names)
