"""BPE encoding and decoding by a deterministic tokenization automaton.

The automaton reads tokens.  It starts as one state that loops on every base symbol.  Each merge
``u v -> w``, in order of rank, adds a gadget: wherever an arc ``u`` is followed by an arc ``v``, an arc
``w`` now leads where the two led together, and the arcs ``u`` are moved to a new state, a copy of the old
one without the arc ``v`` (and, where ``u`` equals ``v``, without the arc ``w``: of three equal symbols the
first two are merged).  What the finished automaton accepts are exactly the sequences that BPE yields, one
for each string.

The state that an arc leads to depends on its token alone, so a state is kept as what its gadget changed:
the state it was copied from and the arcs it took away.  Whether a state has an arc is then answered by
following the gadgets that made the two, and answers are kept in a transition table that fills as it is
used.  A word is encoded by a walk over its symbols: at each place the longest arc that spells on is taken,
and one that leads nowhere is undone.  Decoding emits the labels of the arcs.
"""

from __future__ import annotations

import json
from typing import Any

import regex

#: Words and transitions that one worker keeps; the tables are emptied beyond that.
MOST_WORDS = 400_000
MOST_ARCS = 2_000_000


class TokenAutomaton:
    """The automaton of a list of merges over base symbols."""

    def __init__(self, symbols: list[str], merges: list[tuple[str, str]]) -> None:
        self.labels: list[str] = []
        number: dict[str, int] = {}
        for s in symbols:
            number[s] = len(self.labels)
            self.labels.append(s)
        #: For each arc: the state it leads to now, the arcs a gadget made it from, and when.
        base_arcs = len(self.labels)
        target = [0] * base_arcs
        left, right = [-1] * base_arcs, [-1] * base_arcs
        born = [0] * base_arcs
        #: For each state: what it was copied from, the arc taken away, a second one or -1, and when.
        parent, taken, also, made = [-1], [-1], [-1], [0]
        self.target, self.left, self.right, self.born = target, left, right, born
        self.parent, self.taken, self.also, self.made = parent, taken, also, made
        for rank, (a, b) in enumerate(merges, 1):
            u, v = number.get(a), number.get(b)
            if u is None or v is None or not self._has(target[u], v):
                continue
            label = a + b
            w = number.get(label)
            if w is not None:
                raise ValueError(f"two merges make {label!r}")
            w = number[label] = len(self.labels)
            self.labels.append(label)
            left.append(u)
            right.append(v)
            born.append(rank)
            target.append(target[v])
            fresh = len(parent)
            parent.append(target[u])
            taken.append(v)
            also.append(w if u == v else -1)
            made.append(rank)
            target[u] = fresh
            if u == v:
                target[w] = parent[fresh]
        self.number = number
        self.longest = max(map(len, self.labels))
        self._arcs: dict[tuple[int, int], bool] = {}

    def _has(self, state: int, arc: int) -> bool:
        """Whether a state has an arc: an arc younger than the state stands on its left part's arc."""
        parent, taken, also, made, born, left = self.parent, self.taken, self.also, self.made, self.born, self.left
        while True:
            if taken[state] == arc or also[state] == arc:
                return False
            if born[arc] > made[state]:
                arc = left[arc]
            elif state == 0:
                return True
            else:
                state = parent[state]

    def has_arc(self, last: int, arc: int) -> bool:
        """Whether ``arc`` may follow the arc ``last``."""
        key = (last, arc)
        known = self._arcs.get(key)
        if known is None:
            if len(self._arcs) > MOST_ARCS:
                self._arcs.clear()
            known = self._arcs[key] = self._has(self.target[last], arc)
        return known

    def path(self, word: str, end: str = "") -> list[int]:
        """The arcs that spell ``word`` followed by the mark ``end``."""
        number, longest, has_arc = self.number, self.longest, self.has_arc
        n = len(word)
        spelled = word + end
        taken: list[int] = []
        starts: list[int] = []
        dead: set[tuple[int, int]] = set()
        at = 0
        while at < n:
            last = taken[-1] if taken else -1
            arc = None
            stop = min(n, at + longest)
            while stop > at:
                found = number.get(spelled[at:] if stop == n else spelled[at:stop])
                if found is not None and (last < 0 or has_arc(last, found)) and (stop == n or (found, stop) not in dead):
                    arc = found
                    break
                stop -= 1
            if arc is None:
                if not taken:
                    raise KeyError(word[at : at + 1])
                dead.add((taken[-1], at))
                stop = at
                at = starts.pop()
                taken.pop()
                continue
            taken.append(arc)
            starts.append(at)
            at = stop
        return taken


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte, by the usual rule of byte-level BPE.

    Printable bytes of Latin-1 stand for themselves; the others take the characters from U+0100 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    own = set(plain)
    out, extra = [], 0
    for b in range(256):
        if b in own:
            out.append(chr(b))
        else:
            out.append(chr(0x100 + extra))
            extra += 1
    return out


_ODD = regex.compile(r"[\x1c-\x1f\x85\xa0Σ]|[^\x00-ɏ]")


class WordTokenizer:
    """Encoding and decoding of whole texts for a word-ending BPE file of the tokenizers library.

    Normalisation and pre-splitting follow the file; texts with letters beyond Latin go through the
    library's own normaliser and pre-splitter.  Merging is the automaton's.
    """

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        model = file["model"]
        self.end = model.get("end_of_word_suffix") or ""
        self.bytes = byte_symbols()
        table = {chr(b): c for b, c in enumerate(self.bytes)}
        self._to_symbols = str.maketrans(table)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        ids = model["vocab"]
        symbols = [*self.bytes, *([c + self.end for c in self.bytes] if self.end else [])]
        self.automaton = TokenAutomaton(symbols, merges)
        self.added = {t["content"]: t["id"] for t in file["added_tokens"]}
        self._added = regex.compile("|".join(map(regex.escape, sorted(self.added, key=len, reverse=True)))) if self.added else None
        splits = [p["pattern"]["Regex"] for p in file["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._split = regex.compile(splits[0])
        self._library = Tokenizer.from_file(path)
        self._ids = [str(ids[label]) for label in self.automaton.labels]
        self._known: dict[str, str] = {}
        self._library_words: dict[str, str] = {}
        self._label_of = {str(i): label for label, i in (ids | self.added).items()}

    def _encoded(self, symbols: str) -> str:
        """The ids of a word in symbols, joined by blanks."""
        ids = self._ids
        return " ".join([ids[a] for a in self.automaton.path(symbols, self.end)])

    def _plain_word(self, word: str) -> str:
        if len(self._known) > MOST_WORDS:
            self._known.clear()
        if word.isascii():
            symbols = word  # printable ASCII stands for itself
            if not word.isprintable():
                symbols = word.translate(self._to_symbols)
        else:
            symbols = word.encode().decode("latin-1").translate(self._to_symbols)
        found = self._known[word] = self._encoded(symbols)
        return found

    def _segment(self, text: str) -> list[str]:
        known = self._known
        if _ODD.search(text) is None:
            words = self._split.findall(text.lower())
            get, miss = known.get, self._plain_word
            return [get(w) or miss(w) for w in words]
        normal = self._library.normalizer.normalize_str(text)
        out = []
        for symbols, _ in self._library.pre_tokenizer.pre_tokenize_str(normal):
            found = self._library_words.get(symbols)
            if found is None:
                if len(self._library_words) > MOST_WORDS:
                    self._library_words.clear()
                found = self._library_words[symbols] = self._encoded(symbols)
            out.append(found)
        return out

    def encode(self, text: str) -> tuple[int, str]:
        """The number of ids of a text, and the ids in decimal, joined by one blank."""
        if self._added is None or self._added.search(text) is None:
            parts = self._segment(text)
        else:
            parts, at = [], 0
            for m in self._added.finditer(text):
                parts += self._segment(text[at : m.start()])
                parts.append(str(self.added[m[0]]))
                at = m.end()
            parts += self._segment(text[at:])
        ids = " ".join(parts)
        return (ids.count(" ") + 1 if parts else 0), ids

    def decoded(self, ids: str) -> str:
        """The labels of the arcs that the ids (as ``encode`` gives them) name, as a file without a decoder joins them."""
        return " ".join(map(self._label_of.__getitem__, ids.split()))

    def decode(self, ids: list[int]) -> str:
        """The same for a list of ids."""
        return " ".join([self._label_of[str(i)] for i in ids])


_loaded: dict[str, WordTokenizer] = {}


def loaded(path: str) -> Any:
    """The tokenizer of a file, compiled once in each Python worker."""
    if path not in _loaded:
        _loaded[path] = WordTokenizer(path)
    return _loaded[path]


def encode_decode(
    documents: Any, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text", digests: bool = False
) -> Any:
    """One row per document: ``id_col, n_tokens, ids, decoded``, or with ``digests`` SHA-256 digests instead.

    ``ids`` is an array of token ids, ``decoded`` the text that decoding these ids gives.  With ``digests``
    the same ids (decimal, joined by one blank) and the same decoded text are digested in the worker that
    made them and only ``ids_sha256, decoded_sha256`` leave it.  The tokenizer's file must be at
    ``tokenizer_path`` on every machine.  A null text counts as empty: no ids, empty decoded text.
    Repeated rows and null ids stay as they are; an empty table gives an empty result.
    """
    import hashlib

    import pyarrow as pa
    from pyspark.sql import types as T

    from siftglass.llm.common import arrow_map, id_and_text, id_field

    made = (
        [T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
        if digests
        else [T.StructField("ids", T.ArrayType(T.IntegerType())), T.StructField("decoded", T.StringType())]
    )
    schema = T.StructType([T.StructField("id", id_field(documents, id_col)), T.StructField("n_tokens", T.LongType()), *made])
    hexed = lambda s: hashlib.sha256(s.encode()).hexdigest()

    def run(batches: Any) -> Any:
        tokenizer = loaded(tokenizer_path)
        for batch in batches:
            counts, first, second = [], [], []
            for text in batch.column(1):
                n, ids = tokenizer.encode(text.as_py() or "")
                decoded = tokenizer.decoded(ids)
                counts.append(n)
                first.append(hexed(ids) if digests else [int(i) for i in ids.split()])
                second.append(hexed(decoded) if digests else decoded)
            arrays = [batch.column(0), pa.array(counts, pa.int64())]
            arrays += [pa.array(first, pa.string() if digests else pa.list_(pa.int32())), pa.array(second, pa.string())]
            yield pa.RecordBatch.from_arrays(arrays, names=["id", "n_tokens", *[f.name for f in made]])

    return arrow_map(id_and_text(documents, id_col, text_col), run, schema).withColumnRenamed("id", id_col)
