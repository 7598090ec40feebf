"""Op 3: exact BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token the *last* token of that prefix's BPE result is unique.  It is found among
the vocabulary entries that end at the prefix (reported by a suffix-matching automaton) as the one entry that is
compatible with the last token of the shorter prefix before it, and is stored for every prefix, from the shortest up.
Following the stored entries back from the end gives the exact ids, in time linear in the matches, with no merge loop.
Every pre-token takes this path, whatever its length.

Two neighbouring tokens are compatible when no merge rule would have joined material across their border.  The
symbols that touch the border are the right spine of the left token and the left spine of the right token, each alive
until the rule that consumes it; a rule for two spine symbols that fires while both live breaks the border.

Texts are encoded AT_ONCE bytes at a time: they are split at blanks, each different stretch is encoded once, and the ids are put
together by position.  Stretches and pre-tokens of up to KEPT characters are kept from one batch to the next in stores of
two generations, so that what was used lately stays when a store is full.

Defined results: null text is the empty text, which has no ids and decodes to the empty string; whole texts are
encoded whatever their length; repeated rows are encoded alike; extra columns of the input pass by untouched.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from array import array
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: Fixed: code point distance that marks the last symbol of a word; above every byte-level code point.
END = 0xF0000
#: Entries of a generation of a codec's stores: more costs memory in every Python worker, less costs time.
CACHE = 300_000
#: Characters of the longest stretch that is kept; bytes of text that are encoded together.
KEPT, AT_ONCE = 64, 1 << 23


class Recent:
    """A bounded store: two dicts of at most `size` entries, of which the older one is dropped when the newer one is full."""

    def __init__(self, size: int):
        self.size, self.new, self.old = size, {}, {}

    def get(self, key):
        found = self.new.get(key)
        if found is None and (found := self.old.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        if len(self.new) >= self.size:
            self.old, self.new = self.new, {}
        self.new[key] = value

    def __len__(self) -> int:
        return len(self.new) + len(self.old)


def byte_alphabet() -> list[str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes take the code points from 256 up."""
    out, free = [], 256
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


class BpeCodec:
    """Vocabulary, merge rules and the automaton of one tokenizer file with an end-of-word suffix."""

    def __init__(self, path: str, cache_size: int = CACHE):
        spec = json.load(open(path, encoding="utf-8"))
        model, self.suffix = spec["model"], spec["model"]["end_of_word_suffix"]
        splits = [x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        steps = [x["type"] for x in spec["normalizer"]["normalizers"]]
        if len(splits) != 1 or steps != ["NFC", "Replace", "Lowercase"] or spec["decoder"] is not None:
            raise ValueError(f"{path}: only NFC, blank and lower-case normalising, one splitting pattern and no decoder are known here")
        self._words = regex.compile(splits[0]).findall
        self._alphabet, self._plain = byte_alphabet(), regex.compile("[!-~]+").fullmatch
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special_at = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._special_start = os.path.commonprefix(list(self.special))
        size = max([*model["vocab"].values(), *self.special.values()]) + 1
        self.pieces = np.full(size, "", dtype=object)
        for text, i in [*model["vocab"].items(), *self.special.items()]:
            self.pieces[i] = text
        vocab = model["vocab"]
        self.rule = {}
        parts = {}
        for rank, (a, b) in enumerate(model["merges"]):
            left, right = vocab[a], vocab[b]
            self.rule.setdefault((left, right), rank)
            parts.setdefault(vocab[a + b], (left, right, rank))
        self._parts = parts
        self._spines: dict[tuple[int, bool], list[tuple[int, int]]] = {}
        self._fits = Recent(4 * cache_size)
        self._lengths = [len(self._symbols(p)) for p in self.pieces]
        self._ids = {}
        for text, i in vocab.items():
            symbols = self._symbols(text)
            if len(symbols) == 1 or i in parts and self._whole(i):
                self._ids[symbols] = i
        self.automaton = ahocorasick.Automaton()
        for symbols, i in self._ids.items():
            self.automaton.add_word(symbols, (i, len(symbols)))
        self.automaton.make_automaton()
        self._stretches, self._pieces = Recent(cache_size), Recent(cache_size)

    def _symbols(self, piece: str) -> str:
        if piece.endswith(self.suffix) and len(piece) > len(self.suffix):
            body = piece[: -len(self.suffix)]
            return body[:-1] + chr(ord(body[-1]) + END)
        return piece

    def _spine(self, token: int, right: bool) -> list[tuple[int, int]]:
        """Symbols that touch the token's right (or left) border over time, with the rank of the rule that ends each."""
        key = (token, right)
        if (found := self._spines.get(key)) is None:
            found, ends = [(token, 1 << 60)], 1 << 60
            while token in self._parts:
                left, other, ends = self._parts[token]
                token = other if right else left
                found.append((token, ends))
            self._spines[key] = found
        return found

    def fits(self, left: int, right: int) -> bool:
        """True if BPE leaves the border between the two tokens alone."""
        key = left << 32 | right
        if (known := self._fits.get(key)) is None:
            known, rule = True, self.rule
            for x, x_ends in self._spine(left, True):
                for y, y_ends in self._spine(right, False):
                    r = rule.get((x, y))
                    if r is not None and r < x_ends and r <= y_ends:
                        known = False
                        break
                if not known:
                    break
            self._fits.put(key, known)
        return known

    def _whole(self, token: int) -> bool:
        """True if BPE of the token's own text gives the token."""
        left, right, rank = self._parts[token]
        for x, x_ends in self._spine(left, True):
            for y, y_ends in self._spine(right, False):
                r = self.rule.get((x, y))
                if r is not None and r < rank and r < x_ends and r <= y_ends:
                    return False
        return all(self._whole(t) for t in (left, right) if t in self._parts)

    def last_tokens(self, piece: str) -> list[int]:
        """The last token of every prefix of a pre-token in the byte-level alphabet, by prefix length (0: none, entry 0)."""
        symbols = piece[:-1] + chr(ord(piece[-1]) + END)
        last, known = [-1] * (len(symbols) + 1), self._fits.new.get
        last[0] = 0
        for end, (token, length) in self.automaton.iter(symbols):
            end += 1
            if last[end] < 0:
                start = end - length
                if not start:
                    last[end] = token
                elif (before := last[start]) >= 0:
                    fits = known(before << 32 | token)
                    if fits is None:
                        fits, known = self.fits(before, token), self._fits.new.get
                    if fits:
                        last[end] = token
        return last

    def encode_piece(self, piece: str) -> list[int]:
        """Ids of one pre-token given in the byte-level alphabet: back-pointers followed from its end."""
        last, at, lengths, ids = self.last_tokens(piece), len(piece), self._lengths, []
        while at:
            ids.append(token := last[at])
            at -= lengths[token]
        ids.reverse()
        return ids

    def _encode_stretch(self, stretch: str) -> bytes:
        """Ids of a stretch without blanks, packed."""
        if stretch in self.special:
            return self.special[stretch].to_bytes(4, "little")
        out, store = [], self._pieces
        for word in self._words(stretch.lower() if stretch.isascii() else self._normal(stretch)):
            if (packed := store.new.get(word)) is None:  # as store.get(), without its calls
                if (packed := store.old.get(word)) is None:
                    piece = word if self._plain(word) else "".join(map(self._alphabet.__getitem__, word.encode()))
                    packed = array("I", self.encode_piece(piece)).tobytes()
                if len(word) <= KEPT:
                    store.put(word, packed)
            out.append(packed)
        return out[0] if len(out) == 1 else b"".join(out)

    def encode_column(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, one after the other, and the bounds of each text: blanks always part pre-tokens, and nothing composes across one."""
        texts = pc.fill_null(texts.cast(pa.large_string()), "")
        if self._special_start and (hit := pc.match_substring(texts, self._special_start)).true_count:
            put = self._special_at.sub
            texts = pa.array([put(r" \1 ", t) if h else t for t, h in zip(texts.to_pylist(), hit.to_pylist())], pa.large_string())
        split = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        found = split.flatten().dictionary_encode()
        stretches = found.dictionary.to_numpy(zero_copy_only=False).tolist()
        store, packed = self._stretches, []
        for s in stretches:
            if (p := store.new.get(s)) is None:
                if (p := store.old.get(s)) is None:
                    p = self._encode_stretch(s)
                if len(s) <= KEPT:
                    store.put(s, p)
            packed.append(p)
        ids = np.frombuffer(b"".join(packed), "<u4")
        size = np.fromiter(map(len, packed), np.int64, len(packed)) // 4
        start = np.cumsum(size) - size
        which = found.indices.to_numpy()
        n = size[which]
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.arange(total[-1]) + np.repeat(start[which] - total[:-1], n)
        offsets = split.offsets.to_numpy()
        return ids[at], total[offsets - offsets[0]]

    def encode_batches(self, texts: pa.Array):
        """(first row, ids, bounds) of groups of rows of about AT_ONCE bytes; a longer text is a group of its own."""
        sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        first = 0
        while first < len(texts):
            most = AT_ONCE + (sizes[first - 1] if first else 0)
            end = max(first + 1, int(np.searchsorted(sizes, most, side="right")))
            yield first, *self.encode_column(texts.slice(first, end - first))
            first = end

    def encode(self, text: str | None) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        return self.encode_column(pa.array([text], pa.string()))[0].tobytes()

    @staticmethod
    def _normal(text: str) -> str:
        """NFC and lower case code point by code point (a whole-string lower() would treat a final sigma apart)."""
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "\u03a3" in text:
                return "".join(c.lower() for c in text)
        return text.lower()

    def decode(self, ids: np.ndarray | bytes) -> str:
        """Text of ids (or of packed ids): the file names no decoder, for which the library joins the tokens by one blank."""
        return " ".join(self.pieces[np.frombuffer(ids, "<u4") if isinstance(ids, bytes) else ids])


@lru_cache(maxsize=4)
def codec(path: str, cache_size: int = CACHE) -> BpeCodec:
    """One codec a Python worker, file and size."""
    return BpeCodec(path, cache_size)


def encode_documents(docs: DataFrame, path: str, with_text: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every row; with_text adds ids (binary) and decoded (string)."""
    schema = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string" + ", ids binary, decoded string" * with_text

    def run(batches):
        c = codec(path)
        for batch in batches:
            ids_of, rows = batch.column(0).to_pylist(), []
            for first, ids, bounds in c.encode_batches(batch.column(1)):
                for i, doc_id in enumerate(ids_of[first : first + len(bounds) - 1]):
                    own = ids[bounds[i] : bounds[i + 1]]
                    packed, decoded = own.tobytes(), c.decode(own)
                    row = (doc_id, len(own), hashlib.sha256(packed).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest())
                    rows.append(row + ((packed, decoded) if with_text else ()))
            columns = list(zip(*rows)) if rows else [()] * (6 if with_text else 4)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.binary(), pa.string()]
            names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
            yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(columns, kinds)], names[: len(columns)])

    return docs.selectExpr("cast(doc_id as bigint) doc_id", "cast(text as string) text").mapInArrow(run, schema)
