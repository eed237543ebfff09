"""BPE encoding and decoding by traversal of a prefix-sharing trie.

Each batch's distinct words go into a trie of bytes. A depth-first walk gives every node its state:
the last token of its prefix's encoding. A prefix of i bytes ends in token t of n bytes exactly if the
state at i - n and t stay apart when merged by rank, so a state follows from the states above it and
shared prefixes are computed once. A word's ids are read back along its path.

Defined results: null and empty texts encode to no ids and decode to the empty string; special tokens
in a text become their ids, as the tokenizers library does by default; repeated rows repeat; an empty
table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import gc
import hashlib
import json
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, filterfalse

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import cut, text_batches

#: Fixed pattern of the vocabulary's pre-tokenizer; white space is Unicode's property.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Words and chunks kept between batches, twice over: see Encoder.batch.
CACHED_WORDS = 400_000
#: The same, and texts in a batch, where stages with workers of their own come before and after; what was learnt then goes with the task.
FEW_WORDS, FEW_ROWS = 40_000, 256
#: A mark that is a piece of its own after a word.
MARKS = tuple(".,;:!?)")
#: Texts in a batch: more share more words.
ROWS = 1024
#: Longer words are encoded each time.
CACHED_BYTES = 48


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte: itself where printable, else the next from U+0100."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


class Vocabulary:
    """A byte-level BPE vocabulary: tokens, merges by rank, and which tokens stay apart."""

    def __init__(self, text: str) -> None:
        spec = json.loads(text)
        letters, model = byte_letters(), spec["model"]
        raw = {t: bytes(letters[c] for c in t) for t in model["vocab"] if all(c in letters for c in t)}
        self.id_of = {raw[t]: i for t, i in model["vocab"].items() if t in raw}
        self.bytes_of = {i: b for b, i in self.id_of.items()}
        self.rank: dict[tuple[int, int], tuple[int, int]] = {}
        self.parts: dict[int, tuple[int, int, int]] = {}
        for r, m in enumerate(model["merges"]):
            left, right = m.split(" ") if isinstance(m, str) else m
            a, b = self.id_of[raw[left]], self.id_of[raw[right]]
            whole = self.id_of[raw[left] + raw[right]]
            self.rank.setdefault((a, b), (r, whole))
            self.parts.setdefault(whole, (r, a, b))
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.bytes_of |= {i: s.encode() for s, i in self.special.items()}
        self._sound: dict[int, bool] = {}
        self._edges: dict[tuple[int, bool], list[tuple[int, float]]] = {}
        self.usable = {b: i for b, i in self.id_of.items() if self.sound(i)}
        #: The usable tokens by their bytes: step[node][byte] is the node below, token[node] ends there or is -1.
        self.step: list[dict[int, int]] = [{}]
        self.token = [-1]
        for b, i in self.usable.items():
            node = 0
            for x in b:
                if x not in self.step[node]:
                    self.step[node][x] = len(self.token)
                    self.token.append(-1)
                    self.step.append({})
                node = self.step[node][x]
            self.token[node] = i

    def merge_by_rank(self, word: bytes) -> list[int]:
        """Plain BPE: merge the pair of lowest rank, leftmost first, until none is left."""
        ids = [self.id_of[bytes([b])] for b in word]
        while len(ids) > 1:
            best = min(((self.rank[p][0], i) for i, p in enumerate(zip(ids, ids[1:])) if p in self.rank), default=None)
            if best is None:
                break
            i = best[1]
            ids[i : i + 2] = [self.rank[ids[i], ids[i + 1]][1]]
        return ids

    def edge(self, token: int, right: bool) -> list[tuple[int, float]]:
        """The tokens that stand at one edge of a token while it forms, each with the rank that absorbs it."""
        if (found := self._edges.get((token, right))) is None:
            found, absorbed, t = [], float("inf"), token
            while True:
                found.append((t, absorbed))
                if t not in self.parts:
                    break
                absorbed, t = self.parts[t][0], self.parts[t][2 if right else 1]
            self._edges[token, right] = found
        return found

    def crossed(self, a: int, b: int, before: float = float("inf")) -> bool:
        """Whether a merge of rank under ``before`` joins the edges of a and b before both are absorbed."""
        rank = self.rank
        for x, until in self.edge(a, True):
            for y, until_y in self.edge(b, False):
                if (m := rank.get((x, y))) is not None and m[0] < until and m[0] <= until_y and m[0] < before:
                    return True
        return False

    def sound(self, token: int) -> bool:
        """Whether merging a token's own bytes gives the token: its parts' parts meet at no lower rank."""
        if token not in self.parts:
            return len(self.bytes_of[token]) == 1
        if (known := self._sound.get(token)) is None:
            r, a, b = self.parts[token]
            known = self._sound[token] = self.sound(a) and self.sound(b) and not self.crossed(a, b, r)
        return known


def as_ids(v: Vocabulary, ids: tuple[int, ...]) -> tuple[int, ...]:
    return ids


def as_digest_parts(v: Vocabulary, ids: tuple[int, ...]) -> tuple[int, str, bytes]:
    """How many ids, the ids as decimal text, and what they decode to."""
    return len(ids), ",".join(map(str, ids)), b"".join(map(v.bytes_of.__getitem__, ids))


class Encoder:
    """Encodes texts; keeps what it has learnt of short words.

    A space after anything but white space always starts a piece, so texts are cut there first. ``of`` holds
    each chunk in the form that the caller wants; its key is the chunk without the space before it, or, for
    a chunk that no space precedes, with one behind it."""

    def __init__(self, vocabulary: Vocabulary, form: Callable = as_ids, cached: int = CACHED_WORDS) -> None:
        self.v, self.form, self.cached = vocabulary, form, cached
        self.words = regex.compile(PATTERN)
        self.unsafe = regex.compile(r"\p{White_Space} ")
        self.special = regex.compile("(" + "|".join(map(regex.escape, sorted(vocabulary.special, key=len, reverse=True))) + ")") if vocabulary.special else None
        self.size = {i: len(b) for b, i in vocabulary.usable.items()}
        self.forget()

    def forget(self) -> None:
        """Drop all that was learnt: a worker process outlives its task."""
        self.known: dict[str, tuple[int, ...]] = {}
        self.of: dict[str, object] = {}
        self.apart: dict[int, bool] = {}
        self.older: dict[str, object] = {}
        self.older_words: dict[str, tuple[int, ...]] = {}

    def pieces(self, text: str) -> list[str]:
        if self.special is None or not any(s in text for s in self.v.special):
            return self.words.findall(text)
        out: list[str] = []
        for part in self.special.split(text):
            out += [part] if part in self.v.special else self.words.findall(part)
        return out

    def chunks(self, text: str) -> list[str]:
        """Keys of the text cut before each space, or whole where a cut could fall inside white space or a special token."""
        if self.unsafe.search(text) or text[:1] == " " or any(s in text for s in self.v.special):
            return [text + " "]
        out = text.split(" ")
        out[0] += " "
        return out

    def learn(self, words: Iterable[str]) -> None:
        """Encode the words that are not known yet, all in one trie.

        The trie is the sorted words with the length of the prefix that each shares with the one
        before it; going through them in order is its depth-first walk, and ``state`` holds the
        states of the nodes above."""
        new = []
        for w in words:
            if w in self.v.special:
                self.known[w] = (self.v.special[w],)
            else:
                new.append((w.encode(), w))
        new.sort()
        step, token, size, apart, crossed = self.v.step, self.v.token, self.size, self.apart, self.v.crossed
        # partial[d]: (start, node) of each token that the bytes from start to d begin
        before, state, partial = b"", [-1], [[]]
        for raw, w in new:
            shared, most = 0, min(len(before), len(raw))
            while shared < most and before[shared] == raw[shared]:
                shared += 1
            del state[shared + 1 :], partial[shared + 1 :]
            for depth in range(shared, len(raw)):
                b, last, begun = raw[depth], -1, []
                for start, node in [*partial[depth], (depth, 0)]:
                    if b not in (below := step[node]):
                        continue
                    node = below[b]
                    begun.append((start, node))
                    if last < 0 <= (t := token[node]):
                        if start == 0:
                            last = t
                        else:
                            pair = state[start] << 32 | t
                            ok = apart.get(pair)
                            if ok is None:
                                ok = apart[pair] = not crossed(state[start], t)
                            if ok:
                                last = t
                if last < 0:
                    raise ValueError(f"no token ends the prefix {raw[: depth + 1]!r}")
                state.append(last)
                partial.append(begun)
            before = raw
            out, i = [], len(raw)
            while i:
                out.append(state[i])
                i -= size[state[i]]
            self.known[w] = tuple(reversed(out))

    def batch(self, texts: list[str | None]) -> Iterator[list[str]]:
        """The chunks of each text, all of them known until the next call.

        What is full becomes the older generation; what is used again moves back from it."""
        if len(self.of) > self.cached:
            self.older, self.of = self.of, {}
        if len(self.known) > self.cached:
            self.older_words, self.known = self.known, {}
        if len(self.apart) > 500_000:
            self.apart.clear()
        split = [self.chunks(t) if t else [] for t in texts]
        of, form = self.of, self.form
        new = set(filterfalse(of.__contains__, chain.from_iterable(split)))
        for c in new & self.older.keys():
            of[c] = self.older[c]
        cut = {c: self.cut(c) for c in new if c not in of}
        words = set().union(*cut.values()) - self.known.keys()
        for w in words & self.older_words.keys():
            self.known[w] = self.older_words[w]
        self.learn(w for w in words if w not in self.known)
        known = self.known
        for c, p in cut.items():
            ids = known[p[0]] if p else ()
            for w in p[1:]:
                ids += known[w]
            of[c] = form(self.v, ids)
        yield from split
        for c in [c for c in cut if len(c) > CACHED_BYTES]:
            del of[c]
        for w in [w for w in words if len(w) > CACHED_BYTES]:
            self.known.pop(w, None)

    def cut(self, key: str) -> list[str]:
        """The pieces of a chunk; a word, or a word and one mark, needs no search."""
        space, word = ("", key[:-1]) if key[-1:] == " " else (" ", key)
        if word.isalpha():
            return [space + word]
        if word[-1:] in MARKS and word[:-1].isalpha():
            return [space + word[:-1], word[-1]]
        return self.pieces(space + word)

    def ids(self, chunks: list[str]) -> list[int]:
        return list(chain.from_iterable(map(self.of.__getitem__, chunks)))

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.v.bytes_of.__getitem__, ids)).decode("utf-8", "replace")


_encoders: dict[str, Encoder] = {}


def encoder(vocabulary: str, form: Callable = as_ids, special: bool = True, cached: int = CACHED_WORDS) -> Encoder:
    """One encoder for each worker process, vocabulary and form; special: whether special tokens in a text are encoded as such."""
    key = f"{special} {form.__name__} {hashlib.sha256(vocabulary.encode()).hexdigest()}"
    if key not in _encoders:
        _encoders.clear()
        made = Vocabulary(vocabulary)
        if not special:
            made.special = {}
        _encoders[key] = Encoder(made, form, cached)
    return _encoders[key]


def shared_vocabulary(docs: DataFrame, path: str | None):
    """The vocabulary file's text, a megabyte or two, sent once to each executor."""
    with open(path or default_path(), encoding="utf-8") as f:
        return docs.sparkSession.sparkContext.broadcast(f.read())


def _over_texts(docs: DataFrame, path: str | None, schema: str, form: Callable, make: Callable, cached: int = CACHED_WORDS):
    text_batches(docs.sparkSession)
    vocabulary = shared_vocabulary(docs, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value, form, cached=cached)
        gc.disable()  # nothing here is cyclic, and collections would walk all learnt words again and again
        try:
            for b in cut(batches, FEW_ROWS if cached < CACHED_WORDS else ROWS):
                texts = b.column(1).to_pylist()
                known = e.batch(texts)
                split = [next(known) for _ in texts]
                yield make(e, b.column(0), split)
                next(known, None)
        finally:
            gc.enable()
            if cached < CACHED_WORDS:
                e.forget()
                _encoders.clear()

    return docs.select("doc_id", "text").mapInArrow(run, schema)


def encode(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, ids: the token ids of every whole text."""

    def make(e: Encoder, doc_ids: pa.Array, split: list[list[str]]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([doc_ids, pa.array([e.ids(p) for p in split], pa.list_(pa.int32()))], ["doc_id", "ids"])

    return _over_texts(docs, path, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, ids array<int>", as_ids, make, FEW_WORDS)


def decode(encoded: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, text from doc_id, ids."""
    text_batches(encoded.sparkSession)
    vocabulary = shared_vocabulary(encoded, path)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        e = encoder(vocabulary.value)
        for b in cut(batches):
            texts = [None if ids is None else e.decode(ids) for ids in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, f"doc_id {encoded.schema['doc_id'].dataType.simpleString()}, text string")


def digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256: encode, decode the ids, and digest both."""

    def make(e: Encoder, doc_ids: pa.Array, split: list[list[str]]) -> pa.RecordBatch:
        n, of_ids, of_text = [], [], []
        for s in split:
            count, digits, raw = zip(*map(e.of.__getitem__, s)) if s else ((), (), ())
            n.append(sum(count))
            of_ids.append(hashlib.sha256(",".join(digits).encode()).hexdigest())
            of_text.append(hashlib.sha256(b"".join(raw).decode("utf-8", "replace").encode()).hexdigest())
        return pa.RecordBatch.from_arrays([doc_ids, pa.array(n, pa.int64()), pa.array(of_ids, pa.string()), pa.array(of_text, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _over_texts(docs, path, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string", as_digest_parts, make)
