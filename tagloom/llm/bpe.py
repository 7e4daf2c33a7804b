"""BPE encoding and decoding with forced boundaries.

A pair of bytes that stands next to each other in no token of the vocabulary
can never be merged across, so every such pair marks a certain cut.  Words are
cut there, the fragments are encoded on their own, only the last one with the
word-end mark, and the ids are concatenated.  White space ends a word too, so a
piece of text without white space always has the same ids: bounded tables per
Python worker remember recent pieces.  The new pieces of a bounded stretch of text are
encoded together, all their fragments in whole-array steps.

Which characters are letters, numbers and lower-case forms is the library's own
business: beyond Latin its normaliser and splitter are asked for the words.  The
merging is done here.  The vocabulary is a tokenizers-library JSON file with this model: NFC, lower
case, words by pattern, bytes as symbols, merges, word-end suffix, no decoder.
It is read on the driver and broadcast; its size is fixed by the vocabulary.

Defined results: a null or empty text has no ids and decodes to the empty text;
special tokens in a text get their ids; null ids decode to the empty text.
Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import json
import re
import struct
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Regex, Tokenizer
from tokenizers.pre_tokenizers import Split

from tagloom.llm.common import arrow_rows, narrow

# Fixed: the characters that the pattern \s stands for.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_PIECE, _BLANK = re.compile(f"[^{_SPACE}]+"), re.compile(f"[{_SPACE}]")
_ODD = re.compile("[\x1c-\x1f]")
# Beyond Latin, which characters are letters depends on the Unicode version of the library.
_FAR = re.compile("[^\0-\u024f]")
_REMEMBERED, _LONGEST, _SHORT = 60_000, 64, 64
# Characters of text whose pieces are looked at together.
_TOGETHER = 1 << 19
_NONE = np.int64(1 << 60)


def byte_symbols() -> dict[str, int]:
    """Printable stand-ins for all bytes: Latin-1's visible characters are themselves, the rest follow from U+0100."""
    visible = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(visible)]
    return {chr(b): b for b in visible} | {chr(0x100 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    def __init__(self, raw: str):
        spec = json.loads(raw)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"] or ""
        ids: dict[str, int] = model["vocab"]
        symbols = byte_symbols()
        self.inner, self.last, self.joined = [-1] * 256, [-1] * 256, set()
        for char, byte in symbols.items():
            self.inner[byte], self.last[byte] = ids.get(char, -1), ids.get(char + self.suffix, -1)
        for token in ids:
            body = token.removesuffix(self.suffix) if self.suffix else token
            data = [symbols[c] for c in body if c in symbols]
            self.joined.update(a << 8 | b for a, b in zip(data, data[1:]))
        merges = (m if isinstance(m, list) else m.split(" ") for m in model["merges"])
        pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        self.merges = {ids[a] << 20 | ids[b]: rank << 20 | ids[a + b] for rank, (a, b) in enumerate(pairs)}
        keys = np.fromiter(self.merges, np.int64, len(self.merges))
        order = np.argsort(keys)
        self.keys, self.found = keys[order], np.fromiter(self.merges.values(), np.int64, len(keys))[order]
        made = {found & 0xFFFFF: found >> 20 for found in self.merges.values()}
        # A pair is merged in all places of a fragment at once if no merge builds on a later one.
        self.ordered = all(
            found >> 20 > max(made.get(key >> 20, -1), made.get(key & 0xFFFFF, -1)) for key, found in self.merges.items()
        )
        self.symbols = np.array([self.inner, self.last], np.int64)
        self.inside = np.zeros(1 << 16, bool)
        self.inside[list(self.joined)] = True
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.special_pattern = re.compile("|".join(map(re.escape, sorted(self.special, key=len, reverse=True))) or r"(?!)")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.words = regex.compile(pattern.replace(r"\s", _SPACE))
        self.letters_are_words = not any(t.isalpha() for t in self.special) and self.words.findall("abc") == ["abc"]
        # Only its normaliser is wanted, so the library gets no tokens to hold.
        bare = {**spec, "added_tokens": [], "model": {**model, "vocab": {}, "merges": []}}
        self.normalizer = Tokenizer.from_str(json.dumps(bare)).normalizer
        self.splitter = Split(Regex(pattern), "removed", invert=True)
        self.tokens = [""] * (max([*ids.values(), *self.special.values()]) + 1)
        for token, number in [*ids.items(), *self.special.items()]:
            self.tokens[number] = token
        # Packed ids of recent pieces, in two generations.
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank and product of pairs of tokens, as one number; those that do not merge get the largest."""
        key = left << 20 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.found[at], _NONE)

    def merged(self, ids: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Fragments that begin at ``starts``, each merged on its own: ids, and the fragment of each.

        In every round each fragment merges its pair of lowest rank wherever it stands, from
        left to right; fragments without one are done and leave the arrays.
        """
        owner = np.repeat(np.arange(len(starts)), np.diff(np.append(starts, len(ids))))
        names = np.arange(len(starts))
        rank = np.full(len(ids), _NONE)
        rank[:-1] = np.where(owner[1:] == owner[:-1], self.ranks(ids[:-1], ids[1:]), _NONE)
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(ids):
            least = np.minimum.reduceat(rank, starts)
            alive = least < _NONE
            if not alive.all():
                stays = alive[owner]
                done.append((ids[~stays], names[owner[~stays]]))
                ids, rank = ids[stays], rank[stays]
                owner = (np.cumsum(alive) - 1)[owner[stays]]
                names, least = names[alive], least[alive]
                if not len(ids):
                    break
            at = np.flatnonzero(rank == least[owner])
            # Of overlapping places, equal tokens in a row, every second one.
            first = np.append(True, np.diff(at) > 1)
            at = at[(np.arange(len(at)) - np.flatnonzero(first)[np.cumsum(first) - 1]) % 2 == 0]
            ids[at] = rank[at] & 0xFFFFF
            stays = np.ones(len(ids), bool)
            stays[at + 1] = False
            at = at - np.arange(len(at))
            ids, rank, owner = ids[stays], rank[stays], owner[stays]
            for i in (at, at[at > 0] - 1):
                i = i[i + 1 < len(ids)]
                rank[i] = np.where(owner[i] == owner[i + 1], self.ranks(ids[i], ids[i + 1]), _NONE)
            rank[-1] = _NONE
            starts = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        if not done:
            return ids, owner
        ids, names = (np.concatenate(c) for c in zip(*done))
        order = np.argsort(names, kind="stable")
        return ids[order], names[order]

    def merged_long(self, ids: list[int]) -> list[int]:
        """The same in n log n steps: a heap over linked places."""
        n = len(ids)
        after, before = [*range(1, n), -1], list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            if (found := self.merges.get(ids[i] << 20 | ids[i + 1])) is not None:
                heap.append((found >> 20, i, found & 0xFFFFF, ids[i], ids[i + 1]))
        heapq.heapify(heap)
        while heap:
            _, i, new, left, right = heapq.heappop(heap)
            j = after[i]
            if j < 0 or ids[i] != left or ids[j] != right:
                continue
            ids[i], ids[j], after[i] = new, -1, after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for a, b in ((before[i], i), (i, after[i])):
                if a >= 0 and b >= 0 and (found := self.merges.get(ids[a] << 20 | ids[b])) is not None:
                    heapq.heappush(heap, (found >> 20, a, found & 0xFFFFF, ids[a], ids[b]))
        return [x for x in ids if x >= 0]

    def words_encoded(self, words: list[bytes]) -> list[bytes]:
        """Packed ids of words: cut at every pair of bytes that no token joins, fragments on their own, concatenated."""
        if not words:
            return []
        data = np.frombuffer(b"".join(words), np.uint8).astype(np.int64)
        ends = np.cumsum([len(w) for w in words])
        word = np.repeat(np.arange(len(words)), np.diff(ends, prepend=0))
        last = np.zeros(len(data), np.int64)
        last[ends - 1] = 1
        begins = np.ones(len(data), bool)
        begins[1:] = (last[:-1] == 1) | ~self.inside[data[:-1] << 8 | data[1:]]
        ids = self.symbols[last, data]
        fragment = np.cumsum(begins) - 1
        # Bytes without a symbol vanish; a fragment of nothing else has no ids.
        known = ids >= 0
        ids, fragment, word = ids[known], fragment[known], word[known]
        starts = np.flatnonzero(np.append(True, fragment[1:] != fragment[:-1])) if len(ids) else np.zeros(0, np.int64)
        owners = word[starts]
        long = np.diff(np.append(starts, len(ids))) > (_SHORT if self.ordered else 0)
        if long.any():
            parts = np.split(ids, starts[1:])
            merged = [self.merged_long(p.tolist()) if n else p.tolist() for p, n in zip(parts, long.tolist())]
            ids = np.array([i for m in merged for i in m], np.int64)
            starts = np.cumsum([0, *[len(m) for m in merged[:-1]]])
            short, names = ~long, np.arange(len(starts))
            inside = np.repeat(short, [len(m) for m in merged])
            kept = ids[inside]
            begin = np.cumsum([0, *[len(m) for m, s in zip(merged, short.tolist()) if s][:-1]]) if short.any() else starts[:0]
            fresh, which = self.merged(kept, begin) if len(kept) else (kept, kept)
            which = np.flatnonzero(short)[which]
            ids = np.concatenate([fresh, ids[~inside]])
            which = np.concatenate([which, np.repeat(names, [len(m) for m in merged])[~inside]])
            order = np.argsort(which, kind="stable")
            ids, which = ids[order], which[order]
        else:
            ids, which = self.merged(ids, starts)
        sizes = 4 * np.bincount(owners[which], minlength=len(words))
        packed, upto = ids.astype("<u4").tobytes(), np.cumsum(sizes).tolist()
        return [packed[a:b] for a, b in zip([0, *upto], upto)]

    def words_of(self, text: str) -> list[str]:
        """Words by pattern of text without special tokens and white space."""
        if _FAR.search(text):
            return [w for w, _ in self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))]
        return self.words.findall((text if text.isascii() else unicodedata.normalize("NFC", text)).lower())

    def parts_of(self, piece: str) -> list[str | int]:
        """Words and ids of special tokens of a piece, in order."""
        if self.letters_are_words and piece.isalpha() and piece.isascii():
            return [piece.lower()]
        parts, at = [], 0
        for special in self.special_pattern.finditer(piece):
            parts += [*self.words_of(piece[at : special.start()]), self.special[special[0]]]
            at = special.end()
        return parts + self.words_of(piece[at:] if at else piece)

    def learn(self, pieces: set[str]) -> list[str]:
        """Have the packed ids of all ``pieces`` at hand; returns those that are too long to be remembered."""
        young, old = self.young, self.old
        new = {}
        for piece in pieces:
            if piece in young:
                continue
            known = old.get(piece)
            if known is None:
                new[piece] = self.parts_of(piece)
            else:
                young[piece] = known
        words = list({w for parts in new.values() for w in parts if w.__class__ is str})
        packed = dict(zip(words, self.words_encoded([w.encode() for w in words])))
        for piece, parts in new.items():
            young[piece] = b"".join([packed[p] if p.__class__ is str else struct.pack("<I", p) for p in parts])
        return [p for p in new if len(p) > _LONGEST]

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """Ids of texts as little-endian unsigned 32-bit integers; their pieces are learned together, a bounded stretch at a time."""
        out: list[list[bytes]] = [[] for _ in texts]
        held: list[tuple[int, list[str]]] = []
        size = 0

        def flush() -> None:
            once = self.learn(set().union(*[p for _, p in held]))
            for i, pieces in held:
                out[i].append(b"".join(map(self.young.__getitem__, pieces)))
            held.clear()
            for piece in once:
                del self.young[piece]
            if len(self.young) >= _REMEMBERED:
                self.young, self.old = {}, self.young

        for i, text in enumerate(texts):
            for part in _stretches(text or ""):
                held.append((i, part.split() if part.isascii() and not _ODD.search(part) else _PIECE.findall(part)))
                size += len(part)
                if size >= _TOGETHER:
                    flush()
                    size = 0
        if held:
            flush()
        return [b"".join(parts) for parts in out]

    def encode(self, text: str) -> bytes:
        return self.encode_all([text])[0]

    def decode(self, packed: bytes) -> str:
        """Without a decoder the library joins token strings by spaces."""
        return " ".join(map(self.tokens.__getitem__, np.frombuffer(packed, "<u4").tolist()))


def _stretches(text: str) -> Iterator[str]:
    """A long text in stretches, cut at white space."""
    at = 0
    while len(text) - at > _TOGETHER:
        space = _BLANK.search(text, at + _TOGETHER)
        if space is None:
            break
        yield text[at : space.start()]
        at = space.start()
    yield text[at:] if at else text


@lru_cache(maxsize=1)
def _loaded(raw: str) -> Vocabulary:
    return Vocabulary(raw)


def _shared(df: DataFrame, vocabulary_path: str):
    with open(vocabulary_path, encoding="utf-8") as file:
        return df.sparkSession.sparkContext.broadcast(file.read())


def bpe_encode(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids): ids packed as little-endian unsigned 32-bit integers; one narrow stage."""
    raw = _shared(docs, vocabulary_path)

    def make(ids: list, texts: list) -> list[list]:
        vocabulary = _loaded(raw.value)
        packed = vocabulary.encode_all(texts)
        return [ids, [len(p) // 4 for p in packed], packed]

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(rows, make, "doc_id long, n_tokens long, ids binary", "doc_id", "text")


def bpe_decode(encoded: DataFrame, vocabulary_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids, decoded) of the rows of ``bpe_encode``."""
    raw = _shared(encoded, vocabulary_path)

    def make(ids: list, sizes: list, packed: list) -> list[list]:
        vocabulary = _loaded(raw.value)
        return [ids, sizes, packed, [vocabulary.decode(p) if p else "" for p in packed]]

    schema = "doc_id long, n_tokens long, ids binary, decoded string"
    return arrow_rows(encoded, make, schema, "doc_id", "n_tokens", "ids")


def bpe_round_trip(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_tokens, ids, decoded): encode and decode in one stage, with one Python worker for a task."""
    raw = _shared(docs, vocabulary_path)

    def make(ids: list, texts: list) -> list[list]:
        vocabulary = _loaded(raw.value)
        packed = vocabulary.encode_all(texts)
        return [ids, [len(p) // 4 for p in packed], packed, [vocabulary.decode(p) if p else "" for p in packed]]

    rows = narrow(docs, doc_id=id_col, text=text_col).withColumn("doc_id", F.col("doc_id").cast("long"))
    return arrow_rows(rows, make, "doc_id long, n_tokens long, ids binary, decoded string", "doc_id", "text")
