"""BPE encoding by backtracking, and decoding by an offset table.

One Aho-Corasick pass over a word lists the longest token that starts at each place. Tokens are
taken greedily; a token is accepted if byte-pair merging would keep it beside the one before,
which a table of compatible pairs says (filled as pairs are met). If not, the next shorter token
is tried, and if none is left the token before is given back. A place where that happened is
never tried again, so the work is linear in the word, and the ids are those of exact merging.
Words are encoded once while they stay in a bounded cache.
"""

from __future__ import annotations

import hashlib
import json
import unicodedata
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
import tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trialloom.llm.texts import pieces

#: Fixed value: the white space of the vocabulary's word pattern.
WHITE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Fixed value: the vocabulary's word pattern.
WORD = rf"'s|'t|'re|'ve|'m|'ll|'d|[\p{{L}}]+|[\p{{N}}]|[^{WHITE}\p{{L}}\p{{N}}]+"
CACHED_WORDS, CACHED_PAIRS, LONGEST_CACHED = 300_000, 400_000, 64


@lru_cache(1)
def byte_letters() -> dict[str, int]:
    """Byte for each letter of byte-level vocabularies: printable bytes are themselves."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


@lru_cache(1)
def newer_letters() -> regex.Pattern:
    """Code points that this Python's tables don't know; only the tokenizers library can tell them."""
    new = [c for c in range(0x110000) if unicodedata.category(chr(c)) in ("Cn", "Co")]
    first = [c for c, before in zip(new, [-2, *new]) if c != before + 1]
    last = [c for c, after in zip(new, [*new[1:], -2]) if c != after - 1]
    return regex.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(first, last)) + "]")


class OffsetTable:
    """Byte strings by number: one blob and the offsets where they begin."""

    def __init__(self, pieces: list[bytes]) -> None:
        self.blob = np.frombuffer(b"".join(pieces), np.uint8)
        self.lengths = np.array([len(x) for x in pieces], np.int64)
        self.starts = np.cumsum(self.lengths) - self.lengths

    def join(self, ids: np.ndarray, step: int = 1 << 18) -> Iterator[bytes]:
        """The strings of ``ids`` one after another, some at a time."""
        for at in range(0, len(ids), step):
            some = ids[at : at + step]
            lengths = self.lengths[some]
            ends = np.cumsum(lengths)
            source = np.repeat(self.starts[some] - (ends - lengths), lengths)
            source += np.arange(len(source))
            yield self.blob[source].tobytes()


class Vocabulary:
    """Word-end BPE vocabulary of a tokenizers file, ready to encode and decode."""

    def __init__(self, content: bytes) -> None:
        data = json.loads(content)
        model, end = data["model"], data["model"]["end_of_word_suffix"]
        letters = byte_letters()

        def symbols(token: str) -> str:
            """A token as letters 0 to 255, the last one plus 256 if it ends a word."""
            last = token.endswith(end) and len(token) > len(end)
            body = [letters[c] for c in (token[: -len(end)] if last else token)]
            if last:
                body[-1] += 256
            return "".join(map(chr, body))

        ids = model["vocab"]
        self.ids = {symbols(t): i for t, i in ids.items()}
        self.split: dict[int, tuple[int, int]] = {}
        self.merged: dict[tuple[int, int], int] = {}
        self.rank = {i: -1 for i in ids.values()}
        for rank, (a, b) in enumerate(model["merges"]):
            pair, made = (ids[a], ids[b]), ids[a + b]
            if pair not in self.merged:
                self.merged[pair] = rank
                if made not in self.split:
                    self.split[made], self.rank[made] = pair, rank
        self.special = {x["content"]: x["id"] for x in data["added_tokens"]}
        self.special_pattern = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")")
        names = {i: t for t, i in ids.items()} | {i: t for t, i in self.special.items()}
        every = [names.get(i, "") for i in range(max(names) + 1)]
        self.decoded = OffsetTable([x.encode() + b" " for x in every])
        self.decimals = OffsetTable([b"%d " % i for i in range(len(every))])
        self.word = regex.compile(WORD)
        self.content = content
        self.library: tuple | None = None
        self.cache: dict[str, bytes] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        text_of = {i: s for s, i in self.ids.items()}
        self.length = {i: len(s) for i, s in text_of.items()}
        made: dict[int, bool] = {}
        for i in sorted(text_of, key=self.rank.__getitem__):
            a, b = self.split.get(i, (None, None))
            made[i] = a is None or made[a] and made[b] and self._together(a, b, self.rank[i])
        self.automaton = ahocorasick.Automaton()
        self.shorter: dict[int, int | None] = {}
        for i, s in text_of.items():
            if made[i]:
                self.automaton.add_word(s, (len(s), i))
                own = (self.ids.get(s[:n]) for n in range(len(s) - 1, 0, -1))
                self.shorter[i] = next((x for x in own if x is not None and made[x]), None)
        self.automaton.make_automaton()

    def _together(self, left: int, right: int, limit: int) -> bool:
        """Whether no merge across the border of two tokens comes before rank ``limit``.

        The tokens are taken apart again, the later merge first. Each time, the two parts that
        touch might have merged in the time between: before the merge that used one of them.
        """
        split, rank, merged = self.split, self.rank, self.merged
        while True:
            across = merged.get((left, right))
            if across is not None and across < limit:
                return False
            if left not in split and right not in split:
                return True
            # of equal ranks the left one is merged first
            if rank[left] > rank[right]:
                limit = min(limit, rank[left])
                left = split[left][1]
            else:
                limit = min(limit, rank[right] + 1)
                right = split[right][0]

    def compatible(self, left: int, right: int) -> bool:
        pair = (left, right)
        known = self.pairs.get(pair)
        if known is None:
            if len(self.pairs) >= CACHED_PAIRS:
                self.pairs.clear()
            known = self.pairs[pair] = self._together(left, right, 1 << 60)
        return known

    def encode_word(self, word: str) -> list[int]:
        """Ids of one word of the word pattern."""
        data = word.encode()
        text = data[:-1].decode("latin-1") + chr(256 + data[-1])
        longest: list[int] = [0] * len(text)
        for last, (length, token) in self.automaton.iter(text):
            longest[last + 1 - length] = token  # longer ones come later
        tokens: list[int] = []
        closed = bytearray(len(text) + 1)
        at, token = 0, longest[0]
        while True:
            before = tokens[-1] if tokens else None
            while token is not None:
                end = at + self.length[token]
                if not closed[end] and (before is None or self.compatible(before, token)):
                    break
                token = self.shorter[token]
            if token is None:
                closed[at] = 1
                token = tokens.pop()
                at -= self.length[token]
                continue
            tokens.append(token)
            if end == len(text):
                return tokens
            at, token = end, longest[end]

    def words(self, piece: str) -> list[str]:
        """Normalised words of a piece of text, as the vocabulary's own tokenizer sees them."""
        try:
            piece.encode("latin-1")
        except UnicodeEncodeError:
            if newer_letters().search(piece):
                if self.library is None:
                    own = tokenizers.Tokenizer.from_str(self.content.decode())
                    pattern = json.loads(self.content)["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
                    split = tokenizers.pre_tokenizers.Split(tokenizers.Regex(pattern), "removed", invert=True)
                    self.library = own.normalizer, split
                normalizer, split = self.library
                return [word for word, _ in split.pre_tokenize_str(normalizer.normalize_str(piece))]
        return self.word.findall(lower(unicodedata.normalize("NFC", piece)))

    def _word(self, word: str) -> bytes:
        found = self.cache.get(word)
        if found is None:
            found = np.array(self.encode_word(word), np.int32).tobytes()
            if len(word) <= LONGEST_CACHED:
                if len(self.cache) >= CACHED_WORDS:
                    self.cache.clear()
                self.cache[word] = found
        return found

    def encode(self, text: str | None) -> np.ndarray:
        """Ids of a whole text; none for a null text."""
        out: list[bytes] = []
        for part in self.special_pattern.split(text or ""):
            if part in self.special:
                out.append(np.int32(self.special[part]).tobytes())
                continue
            for piece in pieces(part):
                out.append(b"".join(map(self._word, self.words(piece))))
        return np.frombuffer(b"".join(out), np.int32)

    def decode(self, ids: np.ndarray) -> Iterator[bytes]:
        """UTF-8 of the decoded text in pieces: tokens with one blank between them."""
        yield from _without_last(self.decoded.join(ids))

    def decimal(self, ids: np.ndarray) -> Iterator[bytes]:
        """Decimal ids with one blank between them, in pieces."""
        yield from _without_last(self.decimals.join(ids))


def _without_last(parts: Iterator[bytes]) -> Iterator[bytes]:
    held = b""
    for part in parts:
        if held:
            yield held
        held = part
    yield held[:-1]


def lower(text: str) -> str:
    """Lower case letter by letter: a final sigma is not told apart."""
    return text.lower() if "Σ" not in text else "".join(map(str.lower, text))


_loaded: dict[str, Vocabulary] = {}


class Coder:
    """A vocabulary file as Spark columns; the file itself is of fixed size and is broadcast."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        with open(path, "rb") as file:
            content = file.read()
        name, held = hashlib.sha256(content).hexdigest(), spark.sparkContext.broadcast(content)

        def load() -> Vocabulary:
            if name not in _loaded:
                _loaded.clear()
                _loaded[name] = Vocabulary(held.value)
            return _loaded[name]

        self.load: Callable[[], Vocabulary] = load

    def ids(self, text: Column) -> Column:
        """Token ids of each text (array of int); an empty array for null and empty texts."""
        load = self.load

        @F.arrow_udf("array<int>")
        def column(texts: pa.Array) -> pa.Array:
            vocabulary = load()
            found = [vocabulary.encode(x) for x in texts.to_pylist()]
            return _lists(found)

        return column(text)

    def text(self, ids: Column) -> Column:
        """Decoded text of each array of ids; null for a null array."""
        load = self.load

        @F.arrow_udf("string")
        def column(lists: pa.Array) -> pa.Array:
            vocabulary = load()
            found = (None if x is None else np.array(x, np.int32) for x in lists.to_pylist())
            return pa.array([None if x is None else b"".join(vocabulary.decode(x)).decode() for x in found], pa.string())

        return column(ids)

    def digest(self, text: Column, with_ids: bool = False) -> Column:
        """Struct of ``n_tokens``, ``ids_sha256``, ``decoded_sha256`` and, if asked, ``ids``.

        Each text is encoded, and its ids are decoded by the offset table, in one pass.
        """
        load = self.load

        @F.arrow_udf(
            "n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
        )
        def column(texts: pa.Array) -> pa.Array:
            vocabulary = load()
            counts, first, second, kept = [], [], [], []
            for x in texts.to_pylist():
                ids = vocabulary.encode(x)
                counts.append(len(ids))
                first.append(_sha256(vocabulary.decimal(ids)))
                second.append(_sha256(vocabulary.decode(ids)))
                if with_ids:
                    kept.append(ids)
            arrays = [pa.array(counts, pa.int64()), pa.array(first, pa.string()), pa.array(second, pa.string())]
            names = ["n_tokens", "ids_sha256", "decoded_sha256"]
            if with_ids:
                arrays, names = [*arrays, _lists(kept)], [*names, "ids"]
            return pa.StructArray.from_arrays(arrays, names)

        return column(text)


def _lists(found: list[np.ndarray]) -> pa.Array:
    offsets = np.cumsum([0, *map(len, found)])
    values = np.concatenate(found) if found else np.array([], np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, pa.int32()))


def _sha256(parts: Iterator[bytes]) -> str:
    total = hashlib.sha256()
    for part in parts:
        total.update(part)
    return total.hexdigest()


def encoded(docs: DataFrame, path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every row (and ids, if asked).

    A null text counts as empty: no tokens, and the digests are of the empty string. Repeated rows
    give repeated results; null doc_ids stay null; other columns are not read; an empty table
    gives an empty table. Strings of special tokens in a text are those tokens.
    """
    coder = Coder(docs.sparkSession, path)
    return docs.select("doc_id", coder.digest(F.col("text"), with_ids).alias("digest")).select("doc_id", "digest.*")
