"""Language identification by prediction by partial matching (PPM) over bytes.

For each language a tree of byte contexts of order 0 to ``order`` is counted on a sample of labelled rows and then
frozen. A byte's code length in a context is that of its share of the context's counts (escape method C: a context
with T counts of D different bytes gives the escape D / (T + D)); an unseen byte costs the escape and then its code length
in the next shorter context; a context never seen is passed over at no cost; after order 0 all 256 bytes are equal.
There are no exclusions and no updates, so a text's code length is a sum over its bytes of table values, exact under
the frozen counts. The language with the shortest code wins; the score is its share of all languages' probabilities.

The sample: about ``rows`` labelled documents a language (a documented bound: rows are picked by a hash of their id at
the rate that gives so many), whole texts. Every document is scored whole.

Defined results: a null text, or one without a letter, is ``und`` with score 0, as is everything if nothing could be
learned. Equal code lengths go to the language that comes first by name. Rows without text or language aren't
learned from; a null id counts as empty text in the hash. Very long texts are scored in stretches with their contexts carried over.
Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, crc_bucket, with_row, without_row

ORDER = 3
ROWS = 1_500
UNKNOWN = "und"
STRETCH = 1 << 18


def codes(data: np.ndarray, n: int) -> np.ndarray:
    """Each n consecutive bytes as one number."""
    out = np.zeros(max(len(data) - n + 1, 0), np.uint32)
    for i in range(n):
        out = (out << np.uint32(8)) | data[i : i + len(out)]
    return out


def _framed(text: bytes, order: int) -> np.ndarray:
    return np.frombuffer(b"\0" * order + text, np.uint8)


def _counts(order: int):
    def work(batches):
        for batch in batches:
            found: dict[tuple[str, int], list[np.ndarray]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
                data = _framed(text.encode(), order)
                for n in range(1, order + 2):
                    # A gram ends in a byte of the text; shorter grams skip what only longer contexts see.
                    found.setdefault((lang, n), []).append(codes(data[order + 1 - n :], n))
            for (lang, n), parts in found.items():
                values, counts = np.unique(np.concatenate(parts), return_counts=True)
                if len(values):
                    size = len(values)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([lang] * size), pa.array([n] * size, pa.int32()), pa.array(values.astype(np.int64)), pa.array(counts.astype(np.int64))],
                        ["lang", "n", "code", "count"],
                    )

    return work


class Model:
    """Frozen code lengths: for each gram length its grams, sorted, with bits by language, and the contexts' escapes."""

    def __init__(self, languages: list[str], order: int, grams: dict[tuple[str, int], tuple[np.ndarray, np.ndarray]]):
        self.languages, self.order = languages, order
        self.grams, self.bits, self.contexts, self.escapes = [], [], [], []
        width = len(languages)
        for n in range(1, order + 2):
            own = [grams.get((lang, n), (np.zeros(0, np.uint32), np.zeros(0, np.int64))) for lang in languages]
            every = np.unique(np.concatenate([g for g, _ in own])) if own else np.zeros(0, np.uint32)
            heads = every >> np.uint32(8)
            contexts = np.unique(heads)
            escapes = np.zeros((len(contexts), width))
            lower = self._lower(every, n) if len(every) else np.zeros((0, width))
            bits = np.empty((len(every), width))
            for i, (values, counts) in enumerate(own):
                at = np.searchsorted(contexts, values >> np.uint32(8))
                total = np.bincount(at, counts, len(contexts))
                different = np.bincount(at, minlength=len(contexts))
                seen = total > 0
                escapes[seen, i] = np.log2((total[seen] + different[seen]) / different[seen])
                bits[:, i] = escapes[np.searchsorted(contexts, heads), i] + lower[:, i]
                bits[np.searchsorted(every, values), i] = np.log2((total + different)[at] / counts)
            self.grams.append(every)
            self.bits.append(bits)
            self.contexts.append(contexts)
            self.escapes.append(escapes)

    def _lower(self, grams: np.ndarray, n: int) -> np.ndarray:
        if n == 1:
            return np.full((len(grams), len(self.languages)), 8.0)
        return self.lengths(grams & np.uint32((1 << 8 * (n - 1)) - 1), n - 1)

    def lengths(self, grams: np.ndarray, n: int) -> np.ndarray:
        """Bits of each gram's last byte after the bytes before it, by language."""
        known = self.grams[n - 1]
        if not len(known):
            return self._lower(grams, n)
        at = np.minimum(np.searchsorted(known, grams), len(known) - 1)
        out = self.bits[n - 1][at]
        missed = np.flatnonzero(known[at] != grams)
        if len(missed):
            lost = grams[missed]
            heads, contexts = lost >> np.uint32(8), self.contexts[n - 1]
            where = np.minimum(np.searchsorted(contexts, heads), len(contexts) - 1)
            escape = np.where((contexts[where] == heads)[:, None], self.escapes[n - 1][where], 0.0)
            out[missed] = escape + self._lower(lost, n)
        return out

    def score_all(self, texts: list[bytes]) -> np.ndarray:
        """Bits of whole texts: one row a text, one column a language."""
        out = np.zeros((len(texts), len(self.languages)))
        held, owners, size = [], [], 0
        for i, text in enumerate(texts):
            data = _framed(text, self.order)
            for low in range(0, len(text), STRETCH):
                grams = codes(data[low : low + STRETCH + self.order], self.order + 1)
                held.append(grams)
                owners.append(i)
                size += len(grams)
                if size >= STRETCH:
                    self._add(out, held, owners)
                    held, owners, size = [], [], 0
        self._add(out, held, owners)
        return out

    def _add(self, out, held, owners) -> None:
        if held:
            starts = np.cumsum([0, *(len(x) for x in held[:-1])])
            sums = np.add.reduceat(self.lengths(np.concatenate(held), self.order + 1), starts)
            np.add.at(out, owners, sums)

    def predict(self, texts: list[str | None]) -> Iterator[tuple[str, float]]:
        asked = [i for i, x in enumerate(texts) if x and self.languages and any(map(str.isalpha, x))]
        answer = [(UNKNOWN, 0.0)] * len(texts)
        for i, bits in zip(asked, self.score_all([texts[i].encode() for i in asked]), strict=True):
            best = int(np.argmin(bits))
            answer[i] = (self.languages[best], float(1.0 / np.exp2(bits[best] - bits).sum()))
        return iter(answer)


def learn(labelled: DataFrame, order: int = ORDER, rows: int = ROWS) -> Model:
    """A model from about ``rows`` different documents a language of ``labelled`` (doc_id, text, lang).

    Documents are picked by a hash of id and text, and of rows equal in both one counts, so that rows without an id or
    with few different ids are a sample of the bounded size, too.
    """
    usable = labelled.filter("text IS NOT NULL AND lang IS NOT NULL").withColumn("_pick", F.xxhash64("doc_id", "text"))
    per_language = {r["lang"]: r["n"] for r in usable.groupBy("lang").agg(F.approx_count_distinct("_pick").alias("n")).collect()}
    if not per_language:
        return Model([], order, {})
    share = F.create_map(*[F.lit(x) for lang, n in sorted(per_language.items()) for x in (lang, min(1.0, rows / max(n, 1)))])
    place = F.pmod("_pick", F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = usable.filter(place < share[F.col("lang")]).dropDuplicates(["lang", "_pick"]).select("lang", "text")
    counted = sample.mapInArrow(_counts(order), "lang string, n int, code long, count long")
    # The table has at most order + 1 grams a byte of the bounded sample.
    table = counted.groupBy("lang", "n", "code").agg(F.sum("count").alias("count")).toArrow()
    lang, n = np.array(table["lang"].to_pylist(), object), table["n"].to_numpy()
    code, count = table["code"].to_numpy().astype(np.uint32), table["count"].to_numpy()
    grams = {}
    for key in {*zip(lang.tolist(), n.tolist(), strict=True)}:
        mine = np.flatnonzero((lang == key[0]) & (n == key[1]))
        mine = mine[np.argsort(code[mine])]
        grams[key] = (code[mine], count[mine])
    return Model(sorted({k[0] for k in grams}), order, grams)


def predicted(frame: DataFrame, model: Model) -> DataFrame:
    """``frame`` (with ``text``) with lang_pred and score."""
    shared = frame.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def columns(batch):
            answer = list(own.predict(batch.column("text").to_pylist()))
            return [pa.array([x for x, _ in answer], pa.string()), pa.array([x for _, x in answer], pa.float64())]

        return columns

    return appended(frame, make, "lang_pred string, score double")


def labelled(docs: DataFrame, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in ((id_col, "doc_id"), (text_col, "text"), (lang_col, "lang"))])


def identify(docs: DataFrame, id_col="doc_id", text_col="text", lang_col="lang", rows: int = ROWS, order: int = ORDER) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score; learned from the documents that aren't held out."""
    frame = labelled(docs, id_col, text_col, lang_col)
    held = crc_bucket("doc_id", 3) == 1
    model = learn(frame.filter(~held), order, rows)
    return predicted(frame.select("doc_id", "text", held.alias("held_out")), model).drop("text")


def keep_identified(
    docs: DataFrame, min_score: float = 0.0, id_col="doc_id", text_col="text", lang_col="lang", rows: int = ROWS, order: int = ORDER
) -> DataFrame:
    """The documents, with all their columns, of which a learned language is at least ``min_score`` likely."""
    frame = labelled(docs, id_col, text_col, lang_col)
    model = learn(frame.filter(crc_bucket("doc_id", 3) != 1), order, rows)
    found = predicted(with_row(docs, text=text_col), model)
    kept = found.filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= min_score))
    return without_row(kept, docs.columns, text=text_col)
