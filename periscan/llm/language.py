"""Language identification by compression against a dictionary for each language."""

from __future__ import annotations

import math
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from periscan.llm.arrow import map_texts

#: Bounds of what a dictionary is fitted on: sampled documents of a language, and characters of each, taken at a place that a hash chooses. About 128 KB together.
SAMPLE_DOCS, SAMPLE_CHARS = 512, 256
#: Languages that a model has at most; the dictionaries of more would not fit in a driver's and each task's memory.
MAX_LANGUAGES = 256
#: Bytes compressed at a time; the dictionary counts for the start of a text as for its end.
BLOCK_BYTES = 8 << 10
LEVEL = 3
#: A prediction is rejected if the second language's size is larger by less than this share.
MIN_MARGIN = 0.002
#: Sharpness of the score: a margin of 2 % makes a score of about 0.9.
SHARPNESS = 120.0

_SIGNS = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_compressors: dict[int, list] = {}


class Model:
    """Raw-content dictionaries by language; small, and sent to the tasks with their code."""

    def __init__(self, dictionaries: dict[str, bytes], level: int = LEVEL):
        self.languages = sorted(dictionaries)
        self.dictionaries = [dictionaries[x] for x in self.languages]
        self.level = level
        self.key = hash((level, *self.languages, *self.dictionaries))

    def compressors(self) -> list:
        if self.key not in _compressors:
            import zstandard

            made = []
            for d in self.dictionaries:
                z = zstandard.ZstdCompressionDict(d, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
                z.precompute_compress(level=self.level)
                made.append(zstandard.ZstdCompressor(level=self.level, dict_data=z, write_content_size=False, write_dict_id=False))
            _compressors.clear()  # of models that this worker has done with
            _compressors[self.key] = made
        return _compressors[self.key]

    def sizes(self, text: str) -> list[int]:
        """Compressed bytes of the whole text with each language's dictionary."""
        data = normal(text)
        blocks = [data[k : k + BLOCK_BYTES] for k in range(0, max(1, len(data)), BLOCK_BYTES)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.compressors()]

    def predict(self, text: str | None) -> tuple[str, float, float]:
        """Language, score and margin; ties go to the first language by name."""
        if not text or not self.languages or not has_letter(text):
            return "und", 0.0, 0.0
        sizes = self.sizes(text)
        best = min(range(len(sizes)), key=sizes.__getitem__)
        low = sizes[best]
        if len(sizes) == 1:
            return self.languages[0], 1.0, 1.0
        second = min(s for k, s in enumerate(sizes) if k != best)
        score = 1.0 / sum(math.exp(-SHARPNESS * (s - low) / low) for s in sizes)
        return self.languages[best], score, (second - low) / second


def normal(text: str) -> bytes:
    """The text in lower case, ASCII signs and digits taken for spaces, and runs of spaces for one."""
    return b" ".join(text.lower().encode("utf-8", "replace").translate(_SIGNS).split())


def has_letter(text: str) -> bool:
    return any(m[0].isalpha() for m in re.finditer(r"[^\W\d_]", text))  # signs like a superscript two match, but are no letters


def fit(labelled: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", sample_docs: int = SAMPLE_DOCS) -> Model:
    """Fit dictionaries on a bounded sample: about ``sample_docs`` documents of each language, taken by a hash of the id.

    Equal excerpts count once, so a group of copies doesn't fill a dictionary.
    Each half of the sample is then read with the dictionaries of the other half,
    and what that takes for another language (a wrong label, or a text in two
    languages) is left out. Rows with a null language or text teach nothing. More
    than ``MAX_LANGUAGES`` languages are an error.
    """
    rows = labelled.where(F.col(lang_col).isNotNull() & (F.length(text_col) > 0)).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).limit(MAX_LANGUAGES + 1).collect()}
    if not counts:
        return Model({})
    if len(counts) > MAX_LANGUAGES:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    share = F.create_map(*[x for lang, n in counts.items() for x in (F.lit(lang), F.lit(4.0 * sample_docs / n))])
    place = F.pmod(F.xxhash64("id", F.lit("language")), F.lit(1 << 30)) / F.lit(float(1 << 30))
    picked = (
        rows.where(place < share[F.col("lang")])
        .select("lang", F.substring(F.col("text"), 1 + F.pmod(F.xxhash64("id", F.lit("place")), F.greatest(F.length("text") - SAMPLE_CHARS + 1, F.lit(1))).cast("int"), F.lit(SAMPLE_CHARS)).alias("text"))
        .distinct()
        .select("lang", "text", F.xxhash64("text").alias("h"))
    )
    found: dict[str, list[tuple[int, str]]] = {}
    for r in picked.collect():  # at most about 4 x sample_docs excerpts a language
        found.setdefault(r["lang"], []).append((r["h"], r["text"]))
    sample = {lang: [t for _, t in sorted(xs)[:sample_docs]] for lang, xs in found.items()}
    halves = [{lang: xs[k::2] for lang, xs in sample.items()} for k in (0, 1)]
    cleaned: dict[str, list[str]] = {lang: [] for lang in sample}
    for mine, other in (halves, halves[::-1]):
        judge = _model(other)
        for lang, xs in mine.items():
            cleaned[lang] += [t for t in xs if len(judge.languages) < 2 or judge.predict(t)[0] == lang]
    return _model({lang: xs or sample[lang] for lang, xs in cleaned.items()})


def _model(texts: dict[str, list[str]]) -> Model:
    return Model({lang: normal("\n".join(xs)) for lang, xs in texts.items() if xs})


def identify(docs: DataFrame, model: Model, text_col: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """Adds lang_pred, score (0 to 1), margin and accepted to every document; its text is kept.

    The language whose dictionary compresses the whole text smallest is chosen.
    ``accepted`` is false where the margin to the second is below ``min_margin``.
    Texts that are null or have no letter are ``und`` with score 0, and not accepted.
    Columns of these names in the input are replaced.
    """
    names = ["lang_pred", "score", "margin", "accepted"]

    def add(texts: list) -> list[pa.Array]:
        got = [model.predict(t) for t in texts]
        return [
            pa.array([g[0] for g in got], pa.string()),
            pa.array([g[1] for g in got], pa.float64()),
            pa.array([g[2] for g in got], pa.float64()),
            pa.array([g[0] != "und" and g[2] >= min_margin for g in got], pa.bool_()),
        ]

    fields = [pa.field("lang_pred", pa.string()), pa.field("score", pa.float64()), pa.field("margin", pa.float64()), pa.field("accepted", pa.bool_())]
    source = docs.drop(*names).withColumn("__text", F.col(text_col))
    return map_texts(source, "__text", add, fields, "lang_pred string, score double, margin double, accepted boolean")


def fold(id_col: str = "doc_id"):
    """crc32 of the id as text, modulo 4; 2 is the held-out fold."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 4
