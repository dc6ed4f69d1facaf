"""Token counts by a tokenizer compiled to finite-state machines.

Two deterministic machines are made from a byte-level BPE file; no text goes to the
tokenizer library. The splitter reads classes of code points and says where
words begin. All texts of a slice are one tape, cut into chunks of equal width: each
chunk gives its map from every state to the state after it, the maps are composed by
a parallel prefix scan, and with the state at each chunk's start known all chunks
are read side by side. The merger reads the bytes of a word; each transition is
annotated with the tokens that its byte adds to the count (fewer than none where
bytes read before become one token). Its states are made when first entered:
a state is all that later bytes can ask of those read, so states are finite in
number and words share them. Words read to their end are remembered as one step.
"""

from __future__ import annotations

import json
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import map_batches, slices
from tokenizers import Tokenizer

VOCABULARY, LIMIT = "byte_bpe_50k.json", 1024
#: Characters above which a text's words are dealt over tasks; of one tape; of a chunk.
PIECE, TAPE, CHUNK = 1 << 20, 1 << 20, 128
#: States, and half the words, that a worker remembers before it begins anew; what is forgotten is made again.
REMEMBERED = 250_000

# Classes of code points. Letters that may end a contraction have their own.
LETTER, STMD, R, V, L, E, NUMBER, SPACE, WHITE, QUOTE, OTHER, BREAK = range(12)
# States: nothing read; a word of letters, numbers or marks; white space that ends in a space or not;
# a quote at the start of a word, alone or with r, v, l; a whole contraction.
START, LETTERS, NUMBERS, MARKS, SPACES, WHITES, QUOTED, QUOTED_R, QUOTED_V, QUOTED_L, WHOLE = range(11)
#: What a transition says: a word begins at this code point; at the one before.
HERE, BEFORE = 1, 2


def _splitter() -> tuple[np.ndarray, np.ndarray]:
    """Next state and word starts by (state, class).

    Fixed values, the rule of the file's pre-tokenizer: 's 't 're 've 'm 'll 'd, then letters, numbers
    or marks with at most one space before them, then white space without its last when a word follows.
    """
    letters = {LETTER, STMD, R, V, L, E}
    after, said = np.zeros((11, 12), np.uint8), np.zeros((11, 12), np.uint8)
    first = {c: LETTERS for c in letters} | {NUMBER: NUMBERS, SPACE: SPACES, WHITE: WHITES, QUOTE: QUOTED, OTHER: MARKS, BREAK: START}
    stays = {LETTERS: dict.fromkeys(letters, LETTERS), NUMBERS: {NUMBER: NUMBERS}, MARKS: {OTHER: MARKS, QUOTE: MARKS}, SPACES: {SPACE: SPACES, WHITE: WHITES}, WHITES: {SPACE: SPACES, WHITE: WHITES}}
    stays |= {QUOTED: {STMD: WHOLE, R: QUOTED_R, V: QUOTED_V, L: QUOTED_L, OTHER: MARKS, QUOTE: MARKS}, QUOTED_R: {E: WHOLE}, QUOTED_V: {E: WHOLE}, QUOTED_L: {L: WHOLE}}
    for state in range(11):
        for kind in range(12):
            if kind in stays.get(state, {}):
                after[state, kind] = stays[state][kind]
            elif state == SPACES and kind != BREAK:  # the last space belongs to the word that follows
                after[state, kind], said[state, kind] = MARKS if kind == QUOTE else first[kind], BEFORE
            elif state in (QUOTED_R, QUOTED_V, QUOTED_L):  # no contraction: its letter began a word
                after[state, kind], said[state, kind] = (LETTERS, BEFORE) if kind in letters else (first[kind], BEFORE | HERE)
            else:
                after[state, kind], said[state, kind] = first[kind], HERE | (BEFORE if state == WHITES and kind != BREAK else 0)
    return after, said


def _classes(library: Tokenizer) -> np.ndarray:
    """The class of every code point. Where versions of Unicode differ, the library's own splitter is asked."""
    found, older = np.full(0x110000, OTHER, np.uint8), np.full(0x110000, OTHER, np.uint8)
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    for pattern, kind in ((r"\p{L}+", LETTER), (r"\p{N}+", NUMBER), (r"\p{White_Space}+", WHITE)):
        for run in regex.finditer(pattern, every):
            found[ord(run[0][0]) : ord(run[0][-1]) + 1] = kind
    older[[ord(c) for c in every if unicodedata.category(c)[0] == "L"]] = LETTER
    older[[ord(c) for c in every if unicodedata.category(c)[0] == "N"]] = NUMBER
    older[found == WHITE] = WHITE
    words = library.pre_tokenizer.pre_tokenize_str
    for c in np.flatnonzero(found != older):
        found[c] = next((kind for before, kind in (("a", LETTER), ("1", NUMBER), ("!", OTHER)) if len(words(before + chr(c))) == 1), WHITE)
    for characters, kind in (("stmd", STMD), ("r", R), ("v", V), ("l", L), ("e", E), (" ", SPACE), ("'", QUOTE)):
        found[[ord(c) for c in characters]] = kind
    return found


def _byte_alphabet() -> dict[str, int]:
    """Characters of the vocabulary to bytes: printable Latin-1 stands for itself, other bytes for 256 and on in order."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Merger:
    """Counts the tokens of a word byte by byte.

    The tokens of a text end in t just when the tokens of the text before t end in
    some u such that u and t stay as they are side by side. So a state holds, for each
    place from which the bytes read may still grow to a token: the node of those bytes
    in the vocabulary's trie, the last token before the place, and how many tokens the
    text up to the place has more than the whole.
    """

    def __init__(self, vocabulary: dict[str, int], merges: list, remembered: int):
        alphabet, self.remembered = _byte_alphabet(), remembered
        spelt = {i: bytes(alphabet[c] for c in token) for token, i in vocabulary.items() if all(c in alphabet for c in token)}
        self.rank: dict[tuple[int, int], int] = {}
        #: Of each merged token: twice the rank of its merge, and its two parts.
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, merge in enumerate(merges):
            left, right = merge.split(" ") if isinstance(merge, str) else merge
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            if token in self.made or any(len(spelt[i]) > 1 and i not in self.made for i in pair):
                raise ValueError("a token with several merges, or merged before its parts, can't be compiled")
            self.rank[pair], self.made[token] = 2 * rank, (2 * rank, *pair)
        if len({b for b in spelt.values() if len(b) == 1}) != 256:
            raise ValueError("the vocabulary lacks single bytes")
        self.child: list[dict[int, int]] = [{}]
        self.token = [-1]
        for i, data in spelt.items():
            if len(data) > 1 and not self._comes_up(i):
                continue
            node = 0
            for b in data:
                if b not in self.child[node]:
                    self.child[node][b] = len(self.child)
                    self.child.append({})
                    self.token.append(-1)
                node = self.child[node][b]
            self.token[node] = i
        self.words: dict[bytes, int] = {}
        self.forget()

    def forget(self) -> None:
        self.fits: dict[tuple[int, int], bool] = {}
        self.ids = {(0, -1, 0): 0}
        self.states: list[tuple[int, ...]] = [(0, -1, 0)]
        #: (state, byte) to (state, tokens), each as one number.
        self.steps: dict[int, int] = {}

    def _comes_up(self, token: int) -> bool:
        """Whether the bytes of a token, merged afresh, become that token."""
        if token not in self.made:
            return True
        rank, left, right = self.made[token]
        return self._comes_up(left) and self._comes_up(right) and self._apart(left, right, rank)

    def _apart(self, left: int, right: int, until: float = float("inf")) -> bool:
        """Whether no merge crosses the border of two tokens before ``until``.

        Merges run by rank, then from the left. Those of both tokens that touch the border
        are undone, the latest first; at each time the two parts there must not be a pair
        that is merged before the next of the merges undone.
        """
        while True:
            if self.rank.get((left, right), until) < until:
                return False
            from_left, from_right = self.made.get(left), self.made.get(right)
            if from_right is not None and (from_left is None or from_right[0] >= from_left[0]):
                until, right = from_right[0] + 1, from_right[1]
            elif from_left is not None:
                until, left = from_left[0], from_left[2]
            else:
                return True

    def fit(self, left: int, right: int) -> bool:
        """Whether two tokens stay as they are side by side; any token may come first."""
        known = self.fits.get((left, right))
        if known is None:
            known = self.fits[left, right] = left < 0 or self._apart(left, right)
        return known

    def step(self, state: int, byte: int) -> int:
        """The state after a byte and the tokens that it adds, as one number."""
        places, grown, last, adds = self.states[state], [], -1, 0
        for k in range(0, len(places), 3):
            node = self.child[places[k]].get(byte)
            if node is not None:
                before, more = places[k + 1], places[k + 2]
                token = self.token[node]
                if last < 0 and token >= 0 and self.fit(before, token):
                    last, adds = token, more + 1
                if self.child[node]:
                    grown.append((node, before, more))
        key = (*(x for node, before, more in grown for x in (node, before, more - adds)), 0, last, 0)
        after = self.ids.setdefault(key, len(self.states))
        if after == len(self.states):
            self.states.append(key)
        found = self.steps[state << 8 | byte] = after << 16 | adds + 32768
        return found

    def count(self, word: bytes) -> int:
        known = self.words.get(word)
        if known is None:
            state = known = 0
            steps = self.steps
            for byte in word:
                found = steps.get(state << 8 | byte)
                if found is None:
                    if len(self.states) >= self.remembered:
                        places = self.states[state]
                        self.forget()
                        state, steps = self.ids.setdefault(places, 1), self.steps
                        if state:
                            self.states.append(places)
                    found = self.step(state, byte)
                state = found >> 16
                known += (found & 65535) - 32768
            if len(word) <= 64:
                if len(self.words) >= 2 * self.remembered:
                    self.words.clear()
                self.words[word] = known
        return known


class Counter:
    """A tokenizer file's machines: token counts of many texts."""

    def __init__(self, path: str, remembered: int = REMEMBERED, chunk: int = CHUNK):
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        rule = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
        model, added = told["model"], told["added_tokens"]
        plain = not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "byte_fallback", "ignore_merges"))
        if told["normalizer"] or model["type"] != "BPE" or not plain or any(told["pre_tokenizer"].get(k) != v for k, v in rule.items()):
            raise ValueError("only byte-level BPE without a normalizer can be compiled")
        if any(t[k] for t in added for k in ("single_word", "lstrip", "rstrip")) or any(regex.search(r"\s", t["content"]) for t in added):
            raise ValueError("added tokens that look around them or hold white space can't be compiled")
        self.added = regex.compile("|".join(regex.escape(t["content"]) for t in sorted(added, key=lambda t: -len(t["content"]))) or r"(?!)")
        self.after, self.said = _splitter()
        self.kinds, self.chunk = _classes(Tokenizer.from_file(path)), chunk
        self.merger = Merger(model["vocab"], model["merges"], remembered)

    def word_starts(self, kinds: np.ndarray) -> np.ndarray:
        """Whether a word, or a break, begins at each code point; the tape ends with a break."""
        width = self.chunk
        tape = np.full(-(-len(kinds) // width) * width, BREAK, np.uint8)
        tape[: len(kinds)] = kinds
        columns = np.ascontiguousarray(tape.reshape(-1, width).T)
        maps = np.tile(np.arange(11, dtype=np.uint8), (columns.shape[1], 1))
        flat, said = self.after.ravel(), self.said.ravel()
        for column in columns:  # every state of every chunk
            maps = flat[maps.astype(np.intp) * 12 + column[:, None]]
        far = 1
        while far < len(maps):  # maps of ever longer stretches, composed
            maps[far:] = np.take_along_axis(maps[far:], maps[:-far].astype(np.intp), 1)
            far *= 2
        state = np.concatenate([[START], maps[:-1, START]]).astype(np.intp)
        out = np.empty_like(columns)
        for k, column in enumerate(columns):
            at = state * 12 + column
            out[k], state = said[at], flat[at].astype(np.intp)
        marks = out.T.ravel()[: len(kinds)]
        starts = (marks & HERE) > 0
        starts[:-1] |= (marks[1:] & BEFORE) > 0
        return starts

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each text. The texts are one tape."""
        parts, owner, found = [], [], np.zeros(len(texts), np.int64)
        for k, text in enumerate(texts):
            at = 0
            for special in self.added.finditer(text):
                parts.append(text[at : special.start()])
                owner.append(k)
                found[k] += 1
                at = special.end()
            parts.append(text[at:] if at else text)
            owner.append(k)
        tape = "\n".join([*parts, ""])
        codes = np.frombuffer(tape.encode("utf-32-le"), "<u4")
        if not len(codes):
            return found
        stops = np.cumsum([len(p) + 1 for p in parts]) - 1
        kinds = self.kinds[codes]
        kinds[stops] = BREAK
        starts = np.flatnonzero(self.word_starts(kinds))
        data = tape.encode()
        if len(data) == len(codes):
            offsets = np.append(starts, len(codes))
        else:
            ends = np.cumsum(1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000), dtype=np.int64)
            offsets = np.append(np.where(starts > 0, ends[starts - 1], 0), len(data))
        words = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(data)]).dictionary_encode()
        count = self.merger.count
        tokens = np.fromiter((count(w) for w in words.dictionary.to_pylist()), np.int64)[words.indices.to_numpy()]
        tokens[kinds[starts] == BREAK] = 0
        part = np.searchsorted(stops, starts)
        np.add.at(found, np.asarray(owner)[part], tokens)
        return found

    def batched(self, texts: pa.Array, tape: int = TAPE) -> np.ndarray:
        """Tokens of each text, null for none, by tapes of some characters."""
        sizes = np.cumsum(pc.fill_null(pc.utf8_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)) // tape
        borders = [0, *(np.flatnonzero(np.diff(sizes)) + 1), len(texts)]
        return np.concatenate([np.zeros(0, np.int64), *(self.counts([t or "" for t in texts.slice(a, b - a).to_pylist()]) for a, b in zip(borders, borders[1:]) if b > a)])


@lru_cache(maxsize=1)
def _counter(path: str, remembered: int) -> Counter:
    return Counter(path, remembered)


def _pieces(text: str, size: int) -> Iterator[str]:
    """The text cut before white space that follows other characters, where a word begins whatever was before."""
    at = 0
    while at < len(text):
        cut = regex.compile(r"(?<=\S)(?=\p{White_Space})").search(text, min(at + size, len(text)))
        end = cut.start() if cut else len(text)
        yield text[at:end]
        at = end


def token_counts(docs: DataFrame, path: str, piece: int = PIECE, remembered: int = REMEMBERED) -> DataFrame:
    """doc_id, n_bytes and n_tokens of each row.

    Texts above ``piece`` characters are cut and their pieces dealt over tasks;
    others are counted where they are read, without a shuffle. A null text counts
    as an empty one. Rows that repeat are rows of the result; other columns are not
    read. A word without white space stays whole, whatever its length.
    """
    docs = docs.select("doc_id", "text", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counter(path, remembered)
        for batch in slices(batches):
            tokens = counter.batched(batch["text"])
            rest = [batch[name] for name in batch.schema.names if name != "text"]
            yield pa.RecordBatch.from_arrays([*rest, pa.array(tokens)], names=[*(n for n in batch.schema.names if n != "text"), "n_tokens"])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, 1):
            for k, part in enumerate(_pieces(batch["text"][0].as_py(), piece)):
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["n_bytes"], batch["digest"], pa.array([k], pa.int64()), pa.array([part])], names=["doc_id", "n_bytes", "digest", "part", "text"])

    long = F.coalesce(F.char_length("text") > piece, F.lit(False))
    kind = docs.schema["doc_id"].dataType.simpleString()
    near = map_batches(docs.where(~long), count, f"doc_id {kind}, n_bytes long, n_tokens long")
    parts = map_batches(docs.where(long).withColumn("digest", F.sha2("text", 256)), cut, f"doc_id {kind}, n_bytes long, digest string, part long, text string")
    dealt = parts.repartition(F.xxhash64("digest", "part"), F.col("part"))
    counted = map_batches(dealt, count, f"doc_id {kind}, n_bytes long, digest string, part long, n_tokens long")
    whole = counted.groupBy("doc_id", "n_bytes", "digest").agg(F.sum("n_tokens").alias("n_tokens"), F.count_if(F.col("part") == 0).alias("copies"))
    far = whole.select("doc_id", "n_bytes", F.expr("n_tokens div copies").alias("n_tokens"), F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).drop("copy")
    return near.unionByName(far)


def op11(docs: DataFrame, limit: int = LIMIT, remembered: int = REMEMBERED) -> DataFrame:
    """Token counts of whole texts, and whether they pass ``limit``. A null text has 0 bytes and 0 tokens."""
    counted = token_counts(docs, public_tokenizers.path(VOCABULARY), remembered=remembered)
    return counted.withColumn("over_limit", F.col("n_tokens") > limit)
