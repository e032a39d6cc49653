"""Byte-level BPE encoding and decoding by tree concatenation.

A text is cut at the strings of special tokens; what stands between is encoded by halves: a part longer than
``leaf`` characters is split in two, both halves are encoded on their own, and around each join a growing window is
encoded again until it agrees exactly with what stands left and right of it. Two kinds of join:

* of pieces (what the vocabulary's pattern splits text into): the window runs from a piece of the left half that
  the cut can't have changed to a piece boundary that the window and the right half share; from a shared boundary on
  the pattern splits both alike.
* of merges inside one long piece, text the pattern doesn't split: a window of tokens around the join is merged
  again; when its first and last token are those that were there, every pair of neighbouring tokens is one that the
  merges leave alone, and so the whole is the piece's encoding.

Texts above ``spread`` characters are dealt to tasks leaf by leaf and joined per document; others are encoded
in one task by the same tree. Pieces are encoded by the tokenizers library, each distinct one once while it
stays in a bounded cache.

Defined results: null and empty texts have no ids and decode to the empty text. Repeated rows are encoded one by
one. Empty tables give empty results; other columns never clash.
"""

from __future__ import annotations

import hashlib
import os
import re
from array import array
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from listingflow.llm.common import appended, partitions, staged

LEAF = 1 << 16
SPREAD = 1 << 22
CACHE_ROWS = 400_000
TOGETHER = 1_000_000  # characters whose pieces are held at a time
CHAIN = 500
LONG_PIECE = 4_096

# The vocabulary's pattern in the standard library's syntax, for texts of ASCII, Latin letters and common signs:
# everything whose class (letter, digit, white space, other) is written out here. Other texts take the library's own.
_LETTERS = "A-Za-zÀ-ÖØ-öø-ʯ"
_BLANKS = r"\t-\r "
_SIGNS = "¡-©«-±´¶-¸»¿×÷‐-‧‰-⁞€"
_PLAIN = re.compile(rf"[\x00-\x7f{_LETTERS}{_SIGNS}]*")
_FAST = re.compile(
    rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTERS}]+| ?[0-9]+| ?[^{_BLANKS}0-9{_LETTERS}]+|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
)
_SPACED = re.compile(f" [{_LETTERS}]+")


def byte_letters() -> list[str]:
    """The character that stands for each byte in a byte-level vocabulary: visible ones for themselves."""
    visible = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    hidden = iter(range(256, 512))
    return [chr(b) if b in visible else chr(next(hidden)) for b in range(256)]


class Coder:
    """A byte-level BPE vocabulary, from the text of its tokenizers file."""

    def __init__(self, spec: str, leaf: int = LEAF, cache_rows: int = CACHE_ROWS):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(spec)
        self.library.no_padding()
        self.library.no_truncation()
        self.leaf, self.cache_rows = leaf, cache_rows
        letters = byte_letters()
        self.of_letter = {ord(c): b for b, c in enumerate(letters)}
        self.letters = letters
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        # The library cuts at special tokens before its pattern runs; here the texts are cut already.
        self.library.encode_special_tokens = True
        size = self.library.get_vocab_size()
        self.names = [self.library.id_to_token(i) or "" for i in range(size)]
        self.bytes = [self._raw(name) for name in self.names]
        self.sizes = np.array([len(x) for x in self.bytes])
        self.cache: dict[str, bytes] = {}

    def _raw(self, name: str) -> bytes:
        """A token's bytes; one that isn't in the byte alphabet stands for its own text."""
        try:
            return bytes(self.of_letter[ord(c)] for c in name)
        except KeyError:
            return name.encode()

    # Pieces

    def split(self, text: str) -> list[str]:
        """The text's pieces. The library's own splitter serves texts beyond Latin letters."""
        if _PLAIN.fullmatch(text):
            return _FAST.findall(text)
        found = self.library.pre_tokenizer.pre_tokenize_str(text)
        return [text[a:b] for _, (a, b) in found]

    def learn(self, pieces) -> None:
        """Encode what isn't cached yet; a full cache starts anew."""
        wanted = set(pieces)
        new = wanted.difference(self.cache)
        if not new:
            return
        if len(self.cache) + len(new) > self.cache_rows:
            self.cache = {}
            new = wanted
        spaced = [x for x in new if len(x) <= LONG_PIECE and _SPACED.fullmatch(x)]
        for low in range(0, len(spaced), CHAIN):
            self._learn_chain(spaced[low : low + CHAIN])
        new = new.difference(spaced)
        short = [x for x in new if len(x) <= LONG_PIECE]
        for piece, found in zip(short, self.library.encode_batch_fast(short, add_special_tokens=False), strict=True):
            self.cache[piece] = array("I", found.ids).tobytes()
        for piece in new:
            if len(piece) > LONG_PIECE:
                self.cache[piece] = self.whole_piece(piece).astype("<u4").tobytes()

    def _learn_chain(self, pieces: list[str]) -> None:
        """Pieces of a blank and letters stay pieces when they stand one after the other: one call for many."""
        ids = np.array(self.library.encode_batch_fast(["".join(pieces)], add_special_tokens=False)[0].ids, "<u4")
        ends = np.cumsum([len(x.encode()) for x in pieces])
        cuts = [0, *(np.searchsorted(np.cumsum(self.sizes[ids]), ends) + 1).tolist()]
        raw = ids.tobytes()
        for i, piece in enumerate(pieces):
            self.cache[piece] = raw[4 * cuts[i] : 4 * cuts[i + 1]]

    def ids_of(self, pieces: list[str]) -> list[bytes]:
        self.learn(pieces)
        return list(map(self.cache.__getitem__, pieces))

    # One long piece, token by token

    def merged(self, raw: bytes) -> list[int]:
        return [t.id for t in self.library.model.tokenize("".join([self.letters[b] for b in raw]))]

    def whole_piece(self, piece: str) -> np.ndarray:
        """A piece's ids, by halves of its bytes."""
        raw = piece.encode()
        parts = [raw[i : i + LONG_PIECE] for i in range(0, len(raw), LONG_PIECE)]
        found = [self.merged(x) for x in parts]
        while len(found) > 1:
            found = [self.join_tokens(found[i], found[i + 1]) if i + 1 < len(found) else found[i] for i in range(0, len(found), 2)]
        return np.array(found[0], np.uint32)

    def join_tokens(self, left: list[int], right: list[int]) -> list[int]:
        """The ids of two neighbouring stretches of one piece: a window that grows until both sides agree."""
        k = 8
        while True:
            a, b = left[-k:], right[:k]
            window = self.merged(b"".join(self.bytes[i] for i in (*a, *b)))
            fits_left = k >= len(left) or window[0] == a[0]
            fits_right = k >= len(right) or window[-1] == b[-1]
            if fits_left and fits_right:
                return left[:-k] + window + right[k:]
            k *= 2

    # Stretches of a text: its pieces with their ids

    def encode_part(self, text: str) -> tuple[list[str], list[bytes]]:
        if len(text) <= self.leaf:
            pieces = self.split(text)
            return pieces, self.ids_of(pieces)
        half = len(text) // 2
        return self.join_parts(self.encode_part(text[:half]), self.encode_part(text[half:]))

    def join_parts(self, left, right):
        """Two neighbouring stretches as one."""
        (lp, li), (rp, ri) = left, right
        if not lp or not rp:
            return (lp, li) if lp else (rp, ri)
        k = 4
        while True:
            # A piece that ends three characters before the cut is split alike whatever follows.
            back, first = 0, len(lp)
            while first > 0 and (len(lp) - first < k or back < 3):
                first -= 1
                back += len(lp[first])
            if first > 0:
                first, back = first - 1, back + len(lp[first - 1])
            end = min(k, len(rp))
            after = "".join(rp[end : end + 3])[:8]
            window = self.split("".join(lp[first:]) + "".join(rp[:end]) + after)
            mine = list(accumulate((len(x) for x in window), initial=-back))
            theirs = {at: i for i, at in enumerate(accumulate((len(x) for x in rp[:end]), initial=0))}
            total = mine[-1]
            last = end >= len(rp)
            for n in range(len(window), -1, -1):
                at = mine[n]
                # A boundary counts if what follows it in the window can't change it.
                if at >= 0 and at in theirs and (at + 3 <= total or last and at == total):
                    joined = window[:n]
                    middle = self._joined_ids(joined, lp[first:], li[first:], rp, ri)
                    i = theirs[at]
                    return lp[:first] + joined + rp[i:], li[:first] + middle + ri[i:]
            k *= 4

    def _joined_ids(self, pieces, lp, li, rp, ri):
        """Ids of the window's pieces; a long one made of one piece from each side by its tokens."""
        out = []
        for piece in pieces:
            if len(piece) > LONG_PIECE and lp and len(lp[-1]) + len(rp[0]) == len(piece) and piece == lp[-1] + rp[0]:
                left, right = (np.frombuffer(x, "<u4").tolist() for x in (li[-1], ri[0]))
                out.append(np.array(self.join_tokens(left, right), "<u4").tobytes())
            else:
                out.extend(self.ids_of([piece]))
        return out

    def sections(self, text: str) -> list[str]:
        """The text cut at special tokens: these stand at the odd places."""
        return self.cut.split(text) if self.cut else [text]

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        if not text:
            return b""
        out = []
        for i, section in enumerate(self.sections(text)):
            if i % 2:
                out.append(np.array([self.special[section]], "<u4").tobytes())
            elif section:
                out.extend(self.encode_part(section)[1])
        return b"".join(out)

    def encode_all(self, texts: list[str]) -> list[bytes]:
        """Many texts: what isn't cached yet goes to the library in one call."""
        out, held, size = [], [], 0
        for text in texts:
            held.append(text)
            size += len(text)
            if size >= TOGETHER:
                out += self._encode_few(held)
                held, size = [], 0
        return out + self._encode_few(held)

    def _encode_few(self, texts: list[str]) -> list[bytes]:
        pieces = [
            self.split(x) if len(x) <= self.leaf and not (self.cut and self.cut.search(x)) else None for x in texts
        ]
        self.learn(chain.from_iterable(x for x in pieces if x))
        of = self.cache.__getitem__
        done = [None if x is None else b"".join(map(of, x)) for x in pieces]
        return [self.encode(t) if x is None else x for t, x in zip(texts, done, strict=True)]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.bytes.__getitem__, ids.tolist())).decode("utf-8", "replace")


_CODERS: dict[tuple, Coder] = {}


def coder(spec: str, leaf: int = LEAF, cache_rows: int = CACHE_ROWS) -> Coder:
    """A worker's coder for a vocabulary; kept from task to task."""
    key = (hashlib.sha256(spec.encode()).digest(), leaf, cache_rows)
    if key not in _CODERS:
        _CODERS.clear()
        _CODERS[key] = Coder(spec, leaf, cache_rows)
    return _CODERS[key]


def vocabulary(spark, path: str):
    """The vocabulary file's text, sent to the workers; its size is that of the file."""
    with open(path, encoding="utf-8") as file:
        return spark.sparkContext.broadcast(file.read())


def encoded(frame: DataFrame, spec, leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """``frame`` (with ``text``) with ``ids``: little-endian unsigned 32-bit integers."""

    def make():
        own = coder(spec.value, leaf)

        def columns(batch):
            return [pa.array(own.encode_all([x or "" for x in batch.column("text").to_pylist()]), pa.binary())]

        return columns

    length = F.length(F.coalesce("text", F.lit("")))
    short = appended(frame.filter(length <= spread), make, "ids binary")
    long = frame.filter(length > spread)
    if long.isEmpty():
        return short
    # Long texts get a name, are dealt leaf by leaf, and meet again per text.
    named = staged(long.withColumn("name", F.monotonically_increasing_id()))
    leaves = named.select("name", "text").mapInArrow(_leaves(spec, spread), "name long, section int, leaf int, text string")
    leaves = leaves.repartition(partitions(frame.sparkSession), "name", "section", "leaf")
    parts = leaves.mapInArrow(_encode_leaves(spec, leaf), "name long, section int, leaf int, pieces array<int>, text string, ids binary, counts array<int>")
    whole = parts.groupBy("name").applyInArrow(_join_leaves(spec, leaf), "name long, ids binary")
    return short.unionByName(named.join(whole, "name").select(*short.columns))


def _leaves(spec, size):
    def work(batches):
        own = coder(spec.value)
        for batch in batches:
            for name, text in zip(batch.column("name").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for s, section in enumerate(own.sections(text)):
                    for n, low in enumerate(range(0, len(section), size // 4)):
                        row = [[name], [s], [n], [section[low : low + size // 4]]]
                        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.string())
                        yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(row, kinds, strict=True)], ["name", "section", "leaf", "text"])

    return work


_PART = pa.schema(
    [("name", pa.int64()), ("section", pa.int32()), ("leaf", pa.int32()), ("pieces", pa.list_(pa.int32())), ("text", pa.string())]
    + [("ids", pa.binary()), ("counts", pa.list_(pa.int32()))]
)


def _encode_leaves(spec, leaf):
    def work(batches):
        own = coder(spec.value, leaf)
        for batch in batches:
            for row in batch.to_pylist():
                if row["section"] % 2:
                    pieces, ids = [row["text"]], [np.array([own.special[row["text"]]], "<u4").tobytes()]
                else:
                    pieces, ids = own.encode_part(row["text"])
                row |= {"pieces": [len(x) for x in pieces], "ids": b"".join(ids), "counts": [len(x) for x in ids]}
                yield pa.RecordBatch.from_pylist([row], _PART)

    return work


def _join_leaves(spec, leaf):
    def work(rows: pa.Table) -> pa.Table:
        own = coder(spec.value, leaf)
        sections: dict[int, list] = {}
        for row in sorted(rows.to_pylist(), key=lambda r: (r["section"], r["leaf"])):
            cuts = list(accumulate(row["pieces"], initial=0))
            ends = list(accumulate(row["counts"], initial=0))
            part = (
                [row["text"][a:b] for a, b in zip(cuts, cuts[1:])],  # noqa: B905
                [row["ids"][a:b] for a, b in zip(ends, ends[1:])],  # noqa: B905
            )
            sections.setdefault(row["section"], []).append(part)
        out = []
        for _, parts in sorted(sections.items()):
            while len(parts) > 1:
                parts = [own.join_parts(parts[i], parts[i + 1]) if i + 1 < len(parts) else parts[i] for i in range(0, len(parts), 2)]
            out.extend(parts[0][1])
        name = rows.column("name")[0].as_py()
        return pa.table({"name": pa.array([name], pa.int64()), "ids": pa.array([b"".join(out)], pa.binary())})

    return work


def decoded(frame: DataFrame, spec) -> DataFrame:
    """``frame`` (with ``ids``) with ``decoded``, special tokens included."""

    def make():
        own = coder(spec.value)

        def columns(batch):
            return [pa.array([own.decode(np.frombuffer(x, "<u4")) for x in batch.column("ids").to_pylist()], pa.string())]

        return columns

    return appended(frame, make, "decoded string")


def round_trip(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", leaf: int = LEAF, spread: int = SPREAD) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256."""
    spec = vocabulary(docs.sparkSession, path)
    frame = docs.select(F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def make():
        own = coder(spec.value, leaf)

        def columns(batch):
            ids = batch.column("ids").to_pylist()
            back = [hashlib.sha256(own.decode(np.frombuffer(x, "<u4")).encode()).hexdigest() for x in ids]
            return [
                pa.array([len(x) // 4 for x in ids], pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in ids]),
                pa.array(back),
            ]

        return columns

    out = encoded(frame, spec, leaf, spread)
    digests = appended(out.select("doc_id", "ids"), make, "n_tokens long, ids_sha256 string, decoded_sha256 string")
    return digests.select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256")
