"""BPE as a deterministic automaton, compiled merge by merge.

First over tokens: states stand for the token read last. Before any merge, every base symbol leads on to every other. The
gadget of a merge (u, v) -> uv then does two things to the automaton so far: wherever an arc u is followed by an arc v it
lays an arc uv from the first place to the last, so uv leads to a place with the arcs that v's has by now, and it bars v
from the place that u now leads to. A path spells a word in exactly one way, which is the word's tokenization.

An arc that begins where u's began shares its fate, so a gadget bars v together with all tokens that are made later from
v on the left. Tokens are numbered in preorder of their left parts, later ones first; then what a gadget bars is one range
of numbers, and a state is a sorted list of barred ranges. All of them are built before any text is read.

Then over symbols, which is what a word is read by: a state holds the longest end of the text so far that a token begins
with, and the token read last at each place within it. By a symbol it goes on to just one other, for of the tokens that
end there just one has an arc from the token before it. That is the transition table; its entries are made when they are
first needed, from the compiled ranges, and kept. A word costs one look-up for each symbol, and its tokens are then read
off from its end.
"""

from __future__ import annotations

import json
import re
import unicodedata
from array import array
from bisect import bisect_right
from collections import deque
from collections.abc import Callable
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm.byte_bpe import vocabulary_path
from wordloom.llm.common import map_batches, table, texts


class TokenStates:
    """The automaton over tokens: has(t, v) tells whether the state after t has an arc v.

    whole: tokens with an arc from the start, that is, whose own string is read as this one token.
    """

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]]):
        parts: dict[int, tuple[int, int]] = {}
        for u, v in merges:
            made = vocab[u + v]
            if made in parts:
                raise ValueError(f"two merges make {u + v!r}; the construction needs one for each token")
            parts[made] = vocab[u], vocab[v]
        rank = {made: r for r, made in enumerate(parts)}
        later: dict[int, list[int]] = {}  # the tokens made from one on the left, the latest first
        for made in reversed(parts):
            later.setdefault(parts[made][0], []).append(made)
        number, last, open_ = {}, {}, [i for i in vocab.values() if i not in rank]
        while open_:  # preorder; on the way back a token's range ends
            t = open_.pop()
            if t < 0:
                last[~t] = len(number)
                continue
            number[t] = len(number)
            open_ += [~t, *reversed(later.get(t, ()))]

        barred: dict[int, list[tuple[int, int]]] = {i: [] for i in vocab.values()}
        self.whole = {i for i in vocab.values() if i not in rank}
        for made, (u, v) in parts.items():  # one gadget after the other
            if u in self.whole and v in self.whole and not any(a <= number[v] < b for a, b in barred[u]):
                self.whole.add(made)
            barred[made] = barred[v].copy()
            end = number[v] + 1
            for x in later.get(v, ()):
                if rank[x] < rank[made]:
                    break
                end = last[x]
            barred[u].append((number[v], end))
        self.number, self.first, self.begin, self.end = number, {}, [], []
        for t, ranges in barred.items():
            self.first[t] = len(self.begin)
            high = 0
            for a, b in sorted(ranges):
                if b > high:
                    if a > high or len(self.begin) == self.first[t]:
                        self.begin.append(a)
                        self.end.append(b)
                    else:
                        self.end[-1] = b
                    high = b
        self.until = dict(zip(self.first, [*list(self.first.values())[1:], len(self.begin)], strict=True))

    def has(self, t: int, v: int) -> bool:
        low, n = self.first[t], self.number[v]
        at = bisect_right(self.begin, n, low, self.until[t]) - 1
        return at < low or n >= self.end[at]


class State(dict):
    """A row of the transition table: symbol -> state, filled as it is used."""

    __slots__ = ("automaton", "node", "read", "token")

    def __init__(self, automaton: MergeAutomaton, node: int, read: tuple[int, ...]):
        self.automaton, self.node, self.read, self.token = automaton, node, read, read[-1]

    def __missing__(self, symbol: str) -> State:
        made = self[symbol] = self.automaton.step(self, symbol)
        return made


class MergeAutomaton:
    """vocab: token -> id; merges: pairs in order of rank; suffix: what the last symbol of a word carries; entries: states that are kept, about."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str = "", entries: int = 300_000):
        self.labels, self.suffix, self.entries = {i: t for t, i in vocab.items()}, suffix, entries
        self.tokens = TokenStates(vocab, merges)
        self.length: dict[int, int] = {}
        #: The beginnings of tokens as a tree with, for each, the longest end of it that is one too, and the tokens that end it, longest first.
        self.goto: list[dict[str, int]] = [{}]
        self.depth, ends = [0], {}
        for token, i in vocab.items():
            if i not in self.tokens.whole:
                continue
            plain, node = token.removesuffix(suffix) if suffix else token, 0
            symbols = list(plain)
            if len(plain) < len(token):
                symbols[-1] += suffix
            self.length[i] = len(symbols)
            for c in symbols:
                if (after := self.goto[node].get(c)) is None:
                    after = self.goto[node][c] = len(self.depth)
                    self.goto.append({})
                    self.depth.append(self.depth[node] + 1)
                node = after
            ends[node] = i
        self.shorter, self.ends, queue = [0] * len(self.depth), [()] * len(self.depth), deque([0])
        while queue:
            node = queue.popleft()
            for c, after in self.goto[node].items():
                self.shorter[after] = self._next(self.shorter[node], c) if node else 0
                self.ends[after] = ((ends[after],) if after in ends else ()) + self.ends[self.shorter[after]]
                queue.append(after)
        self._clear()

    def _clear(self) -> None:
        #: States by the node and the tokens read last at the places since the node's beginning; -1 at the start of a word.
        self.start = State(self, 0, (-1,))
        self.states: dict[tuple[int, tuple[int, ...]], State] = {(0, (-1,)): self.start}

    def _next(self, node: int, symbol: str) -> int:
        while (after := self.goto[node].get(symbol)) is None:
            if not node:
                return 0
            node = self.shorter[node]
        return after

    def step(self, state: State, symbol: str) -> State:
        """The state that one goes on to: one more entry of the table."""
        after = self._next(state.node, symbol)
        for token in self.ends[after]:
            before = state.read[-self.length[token]]
            if before < 0 or self.tokens.has(before, token):
                break
        else:
            raise ValueError(f"no token ends with {symbol!r}")
        key = after, (*state.read, token)[-1 - self.depth[after] :]
        found = self.states.get(key)
        if found is None:
            found = self.states[key] = State(self, *key)
        return found

    def encode(self, symbols: str) -> list[int]:
        """The ids of one pre-split word, given as its symbols."""
        if len(self.states) >= self.entries:
            self._clear()
        state, read = self.start, []
        for c in symbols[:-1]:
            state = state[c]
            read.append(state)
        read.append(state[symbols[-1] + self.suffix])
        ids, at, length = [], len(read), self.length
        while at:
            token = read[at - 1].token
            ids.append(token)
            at -= length[token]
        ids.reverse()
        return ids

    def decode(self, ids: list[int]) -> str:
        """The labels of the arcs, joined by one space each (this vocabulary names no decoder)."""
        return " ".join(map(self.labels.__getitem__, ids))


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte: itself where it is printable, else the next from U+0100 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


class Recent(dict):
    """A cache of at least `entries` keys used last: what was looked up since the last turn stays at the next one. made: a key's value."""

    def __init__(self, made: Callable, entries: int):
        super().__init__()
        self.made, self.entries, self.before = made, entries, {}

    def __missing__(self, key):
        value = self.before.get(key)
        if value is None:
            value = self.made(key)
            if len(key) > 64:
                return value
        if len(self) >= self.entries:
            self.before = dict(self)
            self.clear()
        self[key] = value
        return value


class WordBpe:
    """Ids and labels of whole texts. Words and chunks without white space are cached, which changes no result."""

    def __init__(self, path: str, entries: int = 200_000):
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.automaton = MergeAutomaton(spec["model"]["vocab"], [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in spec["model"]["merges"]], spec["model"]["end_of_word_suffix"])
        self.automaton.labels.update({i: t for t, i in special.items()})
        self.words = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        self.special = {t: (np.uint32(i).tobytes(), t) for t, i in special.items()}
        self.split = re.compile("(" + "|".join(map(re.escape, special)) + ")")
        self.space = regex.compile(r"\s+")
        self.symbols = byte_symbols()
        self.of_word, self.of_chunk = Recent(self._word, entries), Recent(self._chunk, entries)

    def _word(self, word: str) -> list[int]:
        return self.automaton.encode(word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode())))

    def _chunk(self, chunk: str) -> tuple[bytes, str]:
        """Ids as bytes, and labels."""
        if chunk.isascii():
            lowered = chunk.lower()
        else:  # lower case letter by letter, without rules for a word's end
            lowered = "".join(map(str.lower, unicodedata.normalize("NFC", chunk)))
        ids = []
        for word in (lowered,) if lowered.isalpha() and lowered.isascii() else self.words.findall(lowered):
            ids += self.of_word[word]
        return array("I", ids).tobytes(), self.automaton.decode(ids)

    def _chunks(self, text: str) -> list[str]:
        #: str.split() cuts at four control characters more than the pre-tokenizer's \s.
        return [c for c in self.space.split(text) if c] if any(c in text for c in "\x1c\x1d\x1e\x1f") else text.split()

    def encode(self, text: str) -> tuple[bytes, str]:
        """Ids as bytes, and the text that decoding them gives."""
        if "<|" in text:
            parts = [x for s in self.split.split(text) for x in ([self.special[s]] if s in self.special else map(self.of_chunk.__getitem__, self._chunks(s)))]
        else:
            parts = list(map(self.of_chunk.__getitem__, self._chunks(text)))
        return b"".join([p[0] for p in parts]), " ".join([p[1] for p in parts if p[1]])


@lru_cache(1)
def word_bpe(path: str) -> WordBpe:
    """One automaton and cache for each worker process."""
    return WordBpe(path)


def encode_words(docs: DataFrame, path: str | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Encode and decode every text: doc_id, ids (binary, four little-endian bytes each) and decoded.

    A null or empty text has no ids and decodes to the empty text; texts and words of any length are read whole. One row
    for each row of docs, repeated ones too, and none for a table without rows.
    """

    def make():
        words = word_bpe(path or vocabulary_path("word_bpe_49k.json"))

        def run(batch: pa.RecordBatch) -> pa.RecordBatch:
            made = [words.encode(t) for t in batch.column("text").to_pylist()]
            return pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array([m[0] for m in made], pa.binary()), pa.array([m[1] for m in made], pa.string())], ["doc_id", "ids", "decoded"])

        return run

    return map_batches(texts(docs, doc_id, text), make, "doc_id long, ids binary, decoded string", "text")


def op7_tokenization_automaton(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's number of ids, and digests of its ids and of the decoded text."""
    return encode_words(table(spark, sf_dir, "documents")).select(
        "doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256")
    )


QUERIES = {"op7_tokenization_automaton": op7_tokenization_automaton}
