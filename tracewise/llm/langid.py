"""Language identification by compression.

For each language a zstandard raw-content dictionary is made of excerpts of labelled texts. A text is encoded once with each
dictionary; the language with the smallest code is its language, and the relative margin to the next is the confidence. Narrow
margins are rejected. Texts are lower-cased and stripped to letters first, and encoded whole, in chunks, each with a constant
filler behind it: zstandard stores blocks that hardly shrink as they are, which would hide all differences in short texts.

The dictionaries are fitted on a bounded sample: of each language PER_LANGUAGE different texts (those of least hash, so the choice
does not depend on order, partitions or copies), EXCERPT characters of each from a place in the whole text that its hash decides.
Everything else works on whole texts of all rows. There is a dictionary and a pass over the texts for each language.

MIN_MARGIN was chosen on held-out rows (2499 of 0.1 GB's size, dictionaries from the others): none was told wrong; the margin rejects
texts of a word or two, in which the languages tie, and halves of two languages; 0.02 rejects clean texts of one repeated word too.

Defined results: null texts and texts without a letter are ``und``, score 0, rejected; so is every text if nothing was learned
from; equal codes are decided for the language with more labelled texts, then by name, with score 0, rejected; repeated rows get
equal results; rows with null labels teach nothing; input columns named like a result column are replaced.
"""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracewise.llm.arrowmap import add_columns, text_of

PER_LANGUAGE, EXCERPT, SALTS = 128, 256, 16
MIN_MARGIN = 0.01
CHUNK = 8192
UNKNOWN = "und"

_FILL = b" " + b"\x00" * 64
_OTHER = re.compile(r"[\W\d_]+")

FIELDS = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("accepted", T.BooleanType())]


def letters(text: str | None) -> str:
    return _OTHER.sub(" ", text.lower()).strip() if text else ""


class Compressors:
    """One compressor for each language, in order of preference."""

    def __init__(self, samples: dict[str, tuple[int, list[str]]], min_margin: float = MIN_MARGIN) -> None:
        import zstandard as Z

        params = Z.ZstdCompressionParameters(window_log=18, chain_log=16, hash_log=16, search_log=3, min_match=3, target_length=32, strategy=Z.STRATEGY_LAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.min_margin = min_margin
        self.all = []
        for lang, (_, texts) in sorted(samples.items(), key=lambda x: (-x[1][0], x[0])):
            content = " ".join(filter(None, map(letters, texts))).encode()
            if len(content) < 8:
                content += b" " * 8
            book = Z.ZstdCompressionDict(content, dict_type=Z.DICT_TYPE_RAWCONTENT)
            book.precompute_compress(compression_params=params)
            code = Z.ZstdCompressor(dict_data=book, compression_params=params)
            self.all.append((lang, code, len(code.compress(_FILL))))

    def sizes(self, raw: bytes) -> list[tuple[int, int]]:
        """(size, rank) of the text for each language, smallest first."""
        chunks = [raw[a : a + CHUNK] + _FILL for a in range(0, len(raw), CHUNK)]
        return sorted((sum(len(code.compress(c)) for c in chunks) - zero * len(chunks), k) for k, (_, code, zero) in enumerate(self.all))

    def predict(self, text: str | None) -> tuple[str, float, bool]:
        kept = letters(text)
        if not self.all or not any(c.isalpha() for c in kept):
            return UNKNOWN, 0.0, False
        sizes = self.sizes(kept.encode("utf-8", "replace"))
        best = self.all[sizes[0][1]][0]
        if len(sizes) == 1:
            return best, 1.0, True
        margin = max(0.0, min(1.0, (sizes[1][0] - sizes[0][0]) / max(1, sizes[1][0])))
        return best, margin, margin >= self.min_margin


def fit(docs: DataFrame, text: str = "text", lang: str = "lang", per_language: int = PER_LANGUAGE, excerpt: int = EXCERPT) -> dict[str, tuple[int, list[str]]]:
    """Labelled texts by language and the sample of each: at most ``per_language`` excerpts."""
    t, g = F.col(f"`{text}`"), F.col(f"`{lang}`")
    place = F.pmod(F.xxhash64(t, F.lit(1)), F.greatest(F.char_length(t) - excerpt + 1, F.lit(1))).cast("int") + 1
    rows = docs.where(t.isNotNull() & g.isNotNull() & t.rlike(r"\p{L}")).select(g.cast("string").alias("g"), F.substr(t, place, F.lit(excerpt)).alias("t"), F.xxhash64(t).alias("h"))
    rows = rows.withColumn("salt", F.pmod(F.col("h"), F.lit(SALTS)))
    in_salt = Window.partitionBy("g", "salt").orderBy("h", "t")
    few = rows.distinct().withColumn("n", F.row_number().over(in_salt)).where(F.col("n") <= -(-per_language // SALTS))
    counts = {r.g: r["count"] for r in rows.groupBy("g").count().collect()}
    found: dict[str, list[str]] = {}
    for r in sorted(few.select("g", "h", "t").collect()):
        found.setdefault(r.g, []).append(r.t)
    return {g: (counts[g], texts) for g, texts in found.items()}


def identify(docs: DataFrame, samples: dict[str, tuple[int, list[str]]], text: str = "text", min_margin: float = MIN_MARGIN) -> DataFrame:
    """``docs`` with lang_pred, score (the margin, 0 to 1) and accepted."""
    shared = docs.sparkSession.sparkContext.broadcast(samples)

    def make():
        model = Compressors(shared.value, min_margin)

        def work(batch):
            seen: dict = {}
            out = []
            for t in text_of(batch, text).to_pylist():
                if t not in seen:
                    seen[t] = model.predict(t)
                out.append(seen[t])
            return [list(c) for c in zip(*out, strict=True)]

        return work

    return add_columns(docs, text, FIELDS, make)
