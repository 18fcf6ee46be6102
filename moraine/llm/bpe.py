"""BPE encoding and decoding by backtracking over Aho-Corasick matches.

The encoder takes the longest token at each place of a word (all matches come
from one Aho-Corasick pass) and keeps it if the pair with the token before it
is compatible: encoding both strings together yields these two tokens again.
If nothing fits, it takes the previous token back and marks the place as dead.
A prefix of a word has one valid encoding, so a dead place stays dead and the
work is linear. Compatibility is decided by walking the right edge of the left
token and the left edge of the right token back in time, and is kept in a table.

encode_all does the same for many texts: it splits them together in arrays and
looks each distinct word up once.

Decoding gathers from one table of all tokens' bytes by offsets.

Nulls in the text count as the empty text: no tokens, an empty decoding. A
null doc_id is passed through; repeated rows give repeated rows; other columns
of the input are not read. Whole texts are encoded, however long.
"""

from __future__ import annotations

import functools
import hashlib
import json
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame, SparkSession

from .common import lean, ready, slices, table

#: Distinct whitespace-free pieces whose ids a worker keeps, at most twice over.
CACHE_ENTRIES = 300_000
_END = 0x10000
_ODD_SPACE = regex.compile("[\x1c-\x1f]")
_SPLIT = regex.compile("[\t-\r \x85\xa0  -     　]+")
_FOREVER = 1 << 60
#: Characters of the longest string that is kept, and of the longest text that is split in arrays.
_KEPT_CHARS, _ARRAY_CHARS = 64, 1 << 20
#: The pattern of words that encode_all knows, and its kinds of characters.
_WORDS = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_OTHER, _SPACE, _LETTER, _NUMBER = range(4)


def byte_chars() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or b >= 0xAE]
    out, extra = [""] * 256, 0
    for b in range(256):
        if b in plain:
            out[b] = chr(b)
        else:
            out[b] = chr(256 + extra)
            extra += 1
    return out


class Pieces(dict):
    """What make gives for short strings, kept in two generations of bounded size."""

    def __init__(self, make, size: int):
        super().__init__()
        self.make, self.size = make, size
        self.old: dict[str, bytes] = {}

    def __missing__(self, piece: str) -> bytes:
        ids = self.old.get(piece)
        if ids is None:
            ids = self.make(piece)
            if len(piece) > _KEPT_CHARS:
                return ids
        if len(self) >= self.size:
            self.age()
        self[piece] = ids
        return ids

    def age(self) -> None:
        self.old = dict(self)
        self.clear()

    def all(self, pieces: list[str]) -> list[bytes]:
        """What make gives for distinct strings, which are kept together."""
        out = list(map(self.get, pieces))
        gaps = [i for i, ids in enumerate(out) if ids is None]
        for i in gaps:
            ids = self.old.get(pieces[i])
            out[i] = self.make(pieces[i]) if ids is None else ids
        if len(self) + len(gaps) > self.size:
            self.age()
        self.update((pieces[i], out[i]) for i in gaps[: self.size] if len(pieces[i]) <= _KEPT_CHARS)
        return out


@functools.cache
def kinds() -> np.ndarray:
    """The kind of each code point."""
    every, out = "".join(map(chr, range(0x110000))), np.full(0x110000, _OTHER, np.uint8)
    for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+"), (_SPACE, _SPLIT.pattern)):
        for found in regex.finditer(pattern, every):
            out[found.start() : found.end()] = kind
    return out


class WordBpe:
    """A BPE vocabulary with word ends, read from a tokenizers file."""

    def __init__(self, path: str, cache: int = CACHE_ENTRIES):
        self.cache = cache
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.suffix = model["end_of_word_suffix"]
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        self.chars = byte_chars()
        vocab: dict[str, int] = model["vocab"]
        size = max([*vocab.values(), *self.special.values()]) + 1
        self.birth, self.left, self.right = [-1] * size, [-1] * size, [-1] * size
        self.merged: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            made, x, y = vocab[a + b], vocab[a], vocab[b]
            self.merged[x, y] = rank
            self.birth[made], self.left[made], self.right[made] = rank, x, y
        self.pairs: dict[tuple[int, int], bool] = {}
        base = set(self.chars) | {c + self.suffix for c in self.chars}
        sound = {i for t, i in vocab.items() if t in base}
        self.trie = ahocorasick.Automaton()
        held: dict[str, int] = {}
        for text, i in sorted(vocab.items(), key=lambda x: self.birth[x[1]]):
            if self.birth[i] >= 0 and self.left[i] in sound and self.right[i] in sound and self.meets(self.left[i], self.right[i], self.birth[i]):
                sound.add(i)
            if i in sound:
                held[self.marked(text)] = i
        #: Characters of each token, and the next shorter token that it begins with.
        self.length, self.shorter = [0] * size, [-1] * size
        for key, i in held.items():
            self.trie.add_word(key, i)
            self.length[i] = len(key)
            self.shorter[i] = next((held[key[:k]] for k in range(len(key) - 1, 0, -1) if key[:k] in held), -1)
        self.trie.make_automaton()
        shown: list[str] = [""] * size
        for text, i in [*vocab.items(), *self.special.items()]:
            shown[i] = text
        parts = [(" " + t).encode() for t in shown]
        self.blob = np.frombuffer(b"".join(parts), np.uint8)
        self.sizes = np.array([len(p) for p in parts], np.int64)
        self.offsets = np.cumsum(self.sizes) - self.sizes
        self.known = Pieces(self.word_bytes, cache)
        self.pieces = Pieces(self.piece_ids, cache)
        self.code = str.maketrans({chr(b): c for b, c in enumerate(self.chars)})
        self.last = {c: chr(_END + ord(c)) for c in self.chars}

    def marked(self, token: str) -> str:
        """A token with its word end folded into its last character."""
        if token.endswith(self.suffix):
            token = token[: -len(self.suffix)]
            return token[:-1] + chr(_END + ord(token[-1]))
        return token

    def meets(self, a: int, b: int, until: int = _FOREVER) -> bool:
        """Whether no merge across the border of a and b comes first, up to rank until."""
        edge, front, end_a, end_b = a, b, until, until
        birth = self.birth
        while True:
            rank = self.merged.get((edge, front))
            if rank is not None and rank < end_a and rank <= end_b and rank != until:
                return False
            if birth[edge] > birth[front]:
                end_a, edge = birth[edge], self.right[edge]
            elif birth[front] >= 0:
                end_b, front = birth[front], self.left[front]
            else:
                return True

    def fits(self, a: int, b: int) -> bool:
        """meets(a, b), kept in the pair table."""
        if len(self.pairs) >= 4 * self.cache:
            self.pairs.clear()
        known = self.pairs[a << 32 | b] = self.meets(a, b)
        return known

    def word_ids(self, word: str) -> list[int]:
        """Ids of one word given in byte characters, its last one marked."""
        pairs = self.pairs
        out: list[int] = []
        last = -1
        for end, token in self.trie.iter_long(word):  # the longest at each place, often right as it is
            if last >= 0:
                fit = pairs.get(last << 32 | token)
                if not (fit or fit is None and self.fits(last, token)):
                    return self.backtrack(word, out, end + 1 - self.length[token], token)
            out.append(token)
            last = token
        return out

    def backtrack(self, word: str, out: list[int], pos: int, token: int) -> list[int]:
        """Go on at pos, where the longest token does not fit the longest ones before it, in out.

        All tokens that match at a place are beginnings of the longest one there.
        """
        length, shorter, pairs, n = self.length, self.shorter, self.pairs, len(word)
        longest = [-1] * n
        for end, t in self.trie.iter(word):
            longest[end + 1 - length[t]] = t  # later ends are longer tokens
        dead: set[int] = set()
        token = shorter[token]
        while True:
            if out:
                before = out[-1] << 32
                while token >= 0:
                    if pos + length[token] not in dead:
                        fit = pairs.get(before | token)
                        if fit or fit is None and self.fits(out[-1], token):
                            break
                    token = shorter[token]
            else:
                while token >= 0 and length[token] in dead:
                    token = shorter[token]
            if token >= 0:
                out.append(token)
                pos += length[token]
                if pos == n:
                    return out
                token = longest[pos]
            else:
                dead.add(pos)
                token = out.pop()
                pos -= length[token]
                token = shorter[token]

    def piece_ids(self, piece: str) -> bytes:
        """Ids of text without white space and special tokens."""
        if piece.isascii():
            lower = piece.lower()
            if lower.isalpha():
                return self.word_bytes(lower) if lower == piece else self.pieces[lower]
            if lower[:-1].isalpha() and not lower[-1].isdigit():
                return self.pieces[lower[:-1]] + self.known[lower[-1]]
            piece = lower
        else:
            piece = self.normal(piece)
        return b"".join(map(self.known.__getitem__, self.words.findall(piece)))

    @staticmethod
    def normal(text: str) -> str:
        return unicodedata.normalize("NFC", text).replace("Σ", "σ").lower()

    def word_bytes(self, word: str) -> bytes:
        marks = word if word.isascii() and word.isalpha() else word.encode("utf-8", "surrogatepass").decode("latin-1").translate(self.code)
        ids = self.word_ids(marks[:-1] + self.last[marks[-1]])
        return struct.pack(f"<{len(ids)}I", *ids)

    def encode(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if "<|" in text:
            parts = self.cut.split(text)
            if len(parts) > 1:
                return b"".join(np.array([self.special[p]], "<u4").tobytes() if p in self.special else self.encode_plain(p) for p in parts)
        return self.encode_plain(text)

    def encode_plain(self, text: str) -> bytes:
        pieces = [x for x in _SPLIT.split(text) if x] if _ODD_SPACE.search(text) else text.split()
        return b"".join(map(self.pieces.__getitem__, pieces))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """encode of each text (null: empty): texts are split together, and each distinct word is looked up once."""
        if self.words.pattern != _WORDS:
            return [self.encode(x or "") for x in texts]
        alone = {i: x for i, x in enumerate(texts) if x and ("<|" in x or len(x) > _ARRAY_CHARS)}
        rows = ["" if i in alone or not x else x.lower() if x.isascii() else self.normal(x) for i, x in enumerate(texts)]
        whole = "\n".join([*rows, "", ""])  # two more line ends: room for looking ahead
        code = np.frombuffer(whole.encode("utf-32-le"), "<u4")
        kind = kinds()[code]
        begins = np.ones(len(code) + 1, bool)
        begins[1:-1] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        at = np.flatnonzero(code == ord("'"))
        at = at[begins[at] & begins[at + 1]]  # not among other signs
        one, two = code[at + 1], code[at + 2]
        short = np.isin(one, [ord(c) for c in "stmd"])
        long = ((one == ord("r")) | (one == ord("v"))) & (two == ord("e")) | (one == ord("l")) & (two == ord("l"))
        begins[at[short | long] + 1] = False
        begins[at[short] + 2] = True
        begins[at[long] + 3] = True
        start = np.flatnonzero(begins)
        full = kind[start[:-1]] != _SPACE
        text, place = whole.encode(), start
        if len(text) > len(code):
            width = 1 + (code >= 0x80).view(np.int8) + (code >= 0x800) + (code >= 0x10000)
            place = np.concatenate([np.zeros(1, np.int64), np.cumsum(width)])[start]
        words = pa.StringArray.from_buffers(len(full), pa.py_buffer(place.astype(np.int32)), pa.py_buffer(text)).filter(pa.array(full)).dictionary_encode()
        listed = pa.ListArray.from_arrays([0, len(words.dictionary)], words.dictionary)
        parts = self.known.all(pc.binary_join(listed, "\n")[0].as_py().split("\n")) if len(words) else []
        blob = np.frombuffer(b"".join(parts), "<u4")
        size = np.fromiter(map(len, parts), np.int64, len(parts)) >> 2
        which = words.indices.to_numpy()
        first, size = (np.cumsum(size) - size)[which], size[which]
        ends = np.concatenate([np.zeros(1, np.int64), np.cumsum(size)])
        index = np.repeat(first - ends[:-1], size)
        index += np.arange(len(index))
        limits = np.cumsum([0, *(len(x) + 1 for x in rows)])
        ids, cut = blob[index].tobytes(), (4 * ends[np.searchsorted(start[:-1][full], limits)]).tolist()
        return [self.encode(alone[i]) if i in alone else ids[a:b] for i, (a, b) in enumerate(zip(cut, cut[1:]))]

    def decode(self, ids: np.ndarray) -> bytes:
        """UTF-8 of the decoded text: the tokens, a blank between each two."""
        if not len(ids):
            return b""
        size = self.sizes[ids]
        ends = np.cumsum(size)
        index = np.repeat(self.offsets[ids] - (ends - size), size)
        index += np.arange(len(index))
        return self.blob[index][1:].tobytes()


@functools.lru_cache(2)
def word_bpe(path: str, cache: int = CACHE_ENTRIES) -> WordBpe:
    """The vocabulary, built once in each Python process. cache: pieces kept, at most twice over."""
    return WordBpe(path, cache)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def bpe_digest(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, n_tokens, ids_sha256, decoded_sha256."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = word_bpe(path)
        for big in batches:
            for batch in slices(big, "text"):
                rows: list[tuple[int, str, str]] = []
                for x in batch.column(1).to_pylist():
                    ids = bpe.encode(x or "")
                    seen = bpe.decode(np.frombuffer(ids, "<u4"))
                    rows.append((len(ids) // 4, hashlib.sha256(ids).hexdigest(), hashlib.sha256(seen).hexdigest()))
                n, a, b = zip(*rows)
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(a), pa.array(b)], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    ready(docs.sparkSession)
    rows = docs.selectExpr(f"cast(`{doc_id}` as bigint) doc_id", f"cast(`{text}` as string) text")
    return rows.mapInArrow(lean(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digest(table(spark, sf_dir, "documents"), default_path())
