"""Language identification by rank-order profiles.

A profile is the ranked list of a language's most frequent letter n-grams (1 to 3 letters, words padded by a blank). A
document's own ranked list is compared to every profile by out-of-place distance: the sum over its n-grams of how far
each one's rank is from its rank in the profile, or the profile's length where it is absent. The profiles are fitted
on a bounded sample of labelled rows; every whole text is predicted in the scan, without a shuffle.

Defined results: `und` with score 0 for null texts, texts without letters, and if there are no labelled rows; equal
distances go to the language first by code point, and n-grams that are equally frequent are ranked by their code points;
texts of any length are counted whole, a slice at a time; a null id counts as the empty text in the fold; repeated rows
get equal predictions; extra columns are ignored or, in `keep_identified`, kept; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tessella.llm.common import as_bytes

#: N-grams of a profile, of a document, and labelled rows a language is fitted on (expected number).
PROFILE, TOP, FIT_ROWS = 400, 300, 1500
#: Code points whose n-grams are counted at once.
SLICE = 1 << 20
UNDETERMINED = "und"


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.fromiter((chr(i).isalpha() for i in range(0x110000)), dtype=bool, count=0x110000)


def _padded(text: str) -> np.ndarray:
    """Code points of the lower-cased letters, with one blank before, between and after words."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype="<u4")
    letter = _letters()[points]
    if not letter.any():
        return np.zeros(0, dtype=np.uint64)
    points = np.where(letter, points, 32)
    keep = letter | np.r_[False, letter[:-1]]
    return np.concatenate([[32], points[keep], [32] if letter[-1] else []]).astype(np.uint64)


def ngrams(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Packed n-grams of a text, sorted, and their counts."""
    points = _padded(text)
    parts = []
    for at in range(0, max(0, len(points)), SLICE):
        a = points[at : at + SLICE + 2]
        n = min(SLICE, len(points) - at)
        one = a[:n][a[:n] != 32]
        two = (a[:-1] << np.uint64(21) | a[1:])[:n]
        three = (a[:-2] << np.uint64(42) | a[1:-1] << np.uint64(21) | a[2:])[:n][(a[1:-1] != 32)[:n]]
        grams = np.concatenate([one, two, three])
        grams.sort()
        cut = np.flatnonzero(np.r_[True, grams[1:] != grams[:-1]])
        parts.append((grams[cut], np.diff(np.r_[cut, len(grams)])))
    if len(parts) == 1:
        return parts[0]
    if not parts:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    grams, back = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    return grams, np.bincount(back, weights=np.concatenate([c for _, c in parts])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent n-grams, ties by code."""
    return grams[np.argsort(-counts, kind="stable")[:top]]


@dataclass(frozen=True)
class Profiles:
    languages: tuple[str, ...]
    grams: np.ndarray  # sorted, of any profile
    ranks: np.ndarray  # of each of them in each language; `length` where absent
    length: int

    def closest(self, text: str, top: int = TOP) -> tuple[str, float]:
        grams, counts = ngrams(text)
        if not len(grams) or not self.languages:
            return UNDETERMINED, 0.0
        own = ranked(grams, counts, top)
        at = np.minimum(np.searchsorted(self.grams, own), len(self.grams) - 1)
        known = self.grams[at] == own
        places = np.arange(len(own))[known, None]
        rank = self.ranks[at[known]]
        apart = np.where(rank == self.length, self.length, np.minimum(np.abs(rank - places), self.length)).sum(axis=0)
        apart = apart + self.length * int((~known).sum())
        best = int(np.argmin(apart))
        return self.languages[best], 1.0 - float(apart[best]) / (self.length * len(own))


def held_out(id_col: str = "doc_id") -> Column:
    """Rows kept from fitting: crc32 of the id as text, modulo 4, is 2."""
    return F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")) % 4 == 2


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        totals: dict[str, dict[int, int]] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            mine = totals.setdefault(lang, {})
            grams, counts = ngrams(text.as_py().decode("utf-8", "replace"))
            for g, c in zip(grams.tolist(), counts.tolist()):
                mine[g] = mine.get(g, 0) + c
        rows = [(lang, g, c) for lang, mine in totals.items() for g, c in mine.items()]
        yield pa.RecordBatch.from_arrays(
            [pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int64()), pa.array([r[2] for r in rows], pa.int64())],
            names=["lang", "gram", "n"],
        )


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", fit_rows: int = FIT_ROWS, profile: int = PROFILE) -> Profiles:
    """Profiles from about `fit_rows` labelled rows a language, picked by a hash of id and text; all rows if there are fewer."""
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    sizes = rows.groupBy(F.col(lang_col).alias("lang")).agg(F.count("*").alias("rows"))
    row = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit("/"), F.col(text_col))
    picked = (
        rows.select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"), F.conv(F.substring(F.md5(row.cast("binary")), 1, 5), 16, 10).cast("long").alias("pick"))
        .join(F.broadcast(sizes), "lang")  # a row a language
        .where(F.col("pick") * F.col("rows") < F.lit(fit_rows * (1 << 20)))
        .select("lang", as_bytes("text").alias("text"))
    )
    counted = picked.mapInArrow(_counted, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("place", F.row_number().over(order) - 1).where(F.col("place") < profile).collect()  # `profile` rows a language
    languages = sorted({r["lang"] for r in top}, key=lambda x: x.encode())
    grams = np.array(sorted({r["gram"] for r in top}), dtype=np.uint64)
    ranks = np.full((len(grams), len(languages)), profile, dtype=np.int64)
    place = {g: i for i, g in enumerate(grams.tolist())}
    for r in top:
        ranks[place[r["gram"]], languages.index(r["lang"])] = r["place"]
    return Profiles(tuple(languages), grams, ranks, profile)


def language_of(profiles: Profiles, text_col: str = "text") -> Column:
    """struct<lang_pred, score> of a text column."""

    @F.arrow_udf("struct<lang_pred: string, score: double>")
    def run(texts: pa.Array) -> pa.Array:
        found = [profiles.closest(t.as_py().decode("utf-8", "replace")) for t in texts]
        return pa.StructArray.from_arrays(
            [pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], names=["lang_pred", "score"]
        )

    return run(as_bytes(text_col))


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", **fit_args: int) -> DataFrame:
    """One row per document: id, held_out, lang_pred, score; fitted on the rows outside the fold."""
    profiles = fit(docs.where(~held_out(id_col)).select(id_col, text_col, lang_col), id_col, text_col, lang_col, **fit_args)
    found = docs.select(F.col(id_col), held_out(id_col).alias("held_out"), language_of(profiles, text_col).alias("found"))
    return found.select(id_col, "held_out", "found.lang_pred", "found.score")


#: Documents that are less like their closest language are rejected; running text of a fitted language is above 0.4.
LEAST_SCORE = 0.25


def keep_identified(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", least_score: float = LEAST_SCORE, **fit_args: int
) -> DataFrame:
    """The documents whose language is identified with `least_score` or more, with all columns; fitted on their own labels outside the fold."""
    profiles = fit(docs.where(~held_out(id_col)).select(id_col, text_col, lang_col), id_col, text_col, lang_col, **fit_args)
    found = language_of(profiles, text_col)
    return docs.where((found["lang_pred"] != UNDETERMINED) & (found["score"] >= least_score))
