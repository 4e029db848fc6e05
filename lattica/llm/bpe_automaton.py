"""Operator 7: BPE encoding and decoding with a tokenization automaton.

The automaton accepts a string of token labels exactly if BPE gives that string.
It starts with one state that loops on every base symbol. Each merge (a, b) -> c,
in order, is a gadget on it:

* arcs labelled a end in a copy of their old end state without the b arc;
* every state that still has an a arc gets a c arc;
* c arcs end where the b arc led, before the gadget.

All arcs of one label share an end state, so a state is named by its label, and
a gadget is the triple (a, b, time). The arcs of a state are those of the state
it was copied from, less the one removed, plus those that later gadgets add, so
whether state u has arc x follows from the gadgets alone; the transition table, by
state and label, holds each answer from its first use. (Filled beforehand it would
have 49k x 49k entries, 300 MB as bits, for each worker; the words of 26 MB of text
use 128,000 of them.) Labels are read symbol by symbol from a second table, by
node and symbol. At most one path leads from the start to a position, so encoding
is one pass over a pre-split word that keeps the last label of the path to each
position and follows the arcs of the table from there; nothing is tried twice.
Decoding walks the ids and emits labels.

Defined results: null text is an empty text (no ids, empty decoded text); rows
are independent, so repeated rows, null ids and ties need nothing special; other
columns, whatever their names, are ignored; an empty table gives an empty result; strings of special tokens in a text become
their ids, as in the library. Whole texts are encoded. Files that are not a
word-level BPE of this kind raise ValueError.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import over_batches, prepare, worker_caches

#: Entries of a worker's table of encoded pieces; it is emptied when full.
MEMO_ENTRIES = 400_000
_MEMO_CHARS = 64
_EVER, _LABEL_BITS = 1 << 62, 32
_INNER, _LAST = 0, 1  # keys of a label in a node; all others are symbols
_CONTROL_SPACES = "\x1c\x1d\x1e\x1f"


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in the vocabulary."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(256, 512))
    return [chr(b) if b in set(plain) else chr(next(rest)) for b in range(256)]


class Automaton:
    """Gadgets of a merge list and the transition table that they define."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str) -> None:
        self.vocab, self.suffix = vocab, suffix
        self.born = [0] * (max(vocab.values()) + 1)
        self.made_of: dict[int, tuple[int, int]] = {}
        self.removed: dict[tuple[int, int], int] = {}
        for time, (left, right) in enumerate(merges, 1):
            a, b, c = vocab[left], vocab[right], vocab[left + right]
            if c in self.made_of:
                raise ValueError(f"two merges make {left + right!r}")
            self.born[c], self.made_of[c], self.removed[a, b] = time, (a, b), time
        self.spelled: dict = {}  # labels by their symbols, as a tree
        for text, i in vocab.items():
            node, last = self.spelled, text.endswith(suffix)
            for symbol in text.removesuffix(suffix):
                node = node.setdefault(symbol, {})
            node[_LAST if last else _INNER] = i
        self.table: dict[tuple[int, int], bool] = {}
        #: the transition table after the last gadget, by state and label
        self.final: dict[int, bool] = {}

    def arc(self, state: int, label: int, time: int) -> bool:
        """Whether the state that label `state` leads to has arc `label` after the gadgets up to `time`."""
        gone = self.removed.get((state, label))
        return (gone is None or gone > time) and self.first_arc(state, label)

    def first_arc(self, state: int, label: int) -> bool:
        """The same when both have just come to exist."""
        known = self.table.get((state, label))
        if known is None:
            at, of = self.born[state], self.born[label]
            if not at and not of:
                known = True
            elif of > at:  # the arc was added by label's gadget
                a, b = self.made_of[label]
                known = self.arc(a, b, of - 1) and self.arc(state, a, of)
            else:  # the state was copied from that of its right part
                a, b = self.made_of[state]
                known = self.arc(b, a if state == label else label, at - 1)
            self.table[state, label] = known
        return known

    def encode(self, symbols: str) -> list[int]:
        """Ids of one pre-split word, given as byte symbols.

        One pass: only one path leads to each position, so it is enough to keep the label that
        it ends with, and no position is taken up again. From each reached position the labels
        that begin there are read symbol by symbol; the table says which of them its state has.
        """
        end, spelled, table = len(symbols), self.spelled, self.final
        last = symbols[end - 1]
        state, origin = [-1] * (end + 1), [0] * (end + 1)
        for start in range(end):
            here = state[start]
            if here < 0 < start:
                continue
            node, stop = spelled, start
            while True:
                if stop == end - 1:
                    # the last symbol ends the word
                    node = node.get(last)
                    label = None if node is None else node.get(_LAST)
                    stop, node = end, None
                else:
                    node = node.get(symbols[stop])
                    if node is None:
                        break
                    stop += 1
                    label = node.get(_INNER)
                if label is not None and state[stop] < 0:
                    allowed = True
                    if start:
                        allowed = table.get(here << _LABEL_BITS | label)
                        if allowed is None:
                            allowed = table[here << _LABEL_BITS | label] = self.arc(here, label, _EVER)
                    if allowed:
                        state[stop], origin[stop] = label, start
                if node is None:
                    break
        if state[end] < 0:
            raise ValueError(f"no path reads {symbols!r}")
        ids, at = [], end
        while at:
            ids.append(state[at])
            at = origin[at]
        return ids[::-1]


Part = tuple[list[int], str, str]


class Tokenizer:
    """A tokenizer file: normalise, pre-split, encode words; decode ids."""

    def __init__(self, path: str, memo_entries: int = MEMO_ENTRIES) -> None:
        self.memo_entries = memo_entries
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        kinds = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        splits = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [])
        if model["type"] != "BPE" or kinds != ["NFC", "Replace", "Lowercase"] or [x["type"] for x in splits] != ["Split", "ByteLevel"] or not model.get("end_of_word_suffix"):
            raise ValueError(f"{path}: not a lower-case BPE with word ends")
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.automaton = Automaton(model["vocab"], merges, model["end_of_word_suffix"])
        self.pieces = regex.compile(splits[0]["pattern"]["Regex"])
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.special_split = re.compile("(" + "|".join(re.escape(x) for x in sorted(self.special, key=len, reverse=True)) + ")")
        self.labels = {i: t for t, i in model["vocab"].items()} | {i: t for t, i in self.special.items()}
        symbols = byte_symbols()
        self.symbols = {b: symbols[b] for b in range(256)}
        #: encoded words, and chunks by how they stand in a text
        self.words: dict[str, Part] = {}
        self.chunks: dict[str, Part] = {}

    def word(self, word: str) -> Part:
        part = self.words.get(word)
        if part is None:
            if len(self.automaton.final) > 4 * self.memo_entries:
                self.automaton.final.clear()
                self.automaton.table.clear()
            symbols = word if word.isascii() and word.isprintable() else "".join(map(self.symbols.__getitem__, word.encode("utf-8")))
            ids = self.automaton.encode(symbols)
            part = ids, " ".join(map(str, ids)), self.decode(ids)
            if len(word) <= _MEMO_CHARS:
                if len(self.words) >= self.memo_entries:
                    self.words.clear()
                self.words[word] = part
        return part

    def chunk(self, chunk: str) -> Part:
        """Ids of a run without white space, the same as text, and their labels joined by spaces."""
        lower = chunk.lower() if chunk.isascii() else chunk.replace("Σ", "σ").lower()  # letter by letter: no final sigma
        if lower.isalpha():
            return self.word(lower)
        parts = [self.word(w) for w in self.pieces.findall(lower)]
        return [i for p in parts for i in p[0]], " ".join([p[1] for p in parts]), " ".join([p[2] for p in parts])

    def decode(self, ids) -> str:
        return " ".join(map(self.labels.__getitem__, ids))

    def parts(self, text: str) -> list[Part]:
        """The encoded chunks of a text in order."""
        if "<|" in text and len(split := self.special_split.split(text)) > 1:
            return [p for x in split for p in (self.one_special(x) if x in self.special else self.plain(x))]
        return self.plain(text)

    def one_special(self, label: str) -> list[Part]:
        i = self.special[label]
        return [([i], str(i), label)]

    def plain(self, text: str) -> list[Part]:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        chunks = regex.split(r"\s+", text) if any(c in text for c in _CONTROL_SPACES) else text.split()
        known, out = self.chunks, []
        for c in chunks:
            part = known.get(c)
            if part is None:
                part = self.chunk(c)
                if len(c) <= _MEMO_CHARS:
                    if len(known) >= self.memo_entries:
                        known.clear()
                    known[c] = part
            if part[0]:
                out.append(part)
        return out

    def encode(self, text: str) -> list[int]:
        return [i for p in self.parts(text) for i in p[0]]


@lru_cache(maxsize=1)
def load(path: str, memo_entries: int = MEMO_ENTRIES) -> Tokenizer:
    return Tokenizer(path, memo_entries)


worker_caches["bpe"] = load.cache_clear


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def encode_documents(docs: DataFrame, path: str | None = None, with_ids: bool = False, memo_entries: int = MEMO_ENTRIES) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 and, if asked for, token_ids.

    path is a tokenizer file on every executor (None: the installed one);
    memo_entries bounds what a worker keeps.
    """
    prepare(docs.sparkSession)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        tokenizer = load(path or default_path(), memo_entries)
        n, ids_hash, text_hash, ids = [], [], [], []
        for text in batch.column(1).to_pylist():
            parts = tokenizer.parts(text or "")
            n.append(sum(len(p[0]) for p in parts))
            ids_hash.append(hashlib.sha256(" ".join([p[1] for p in parts]).encode()).hexdigest())
            text_hash.append(hashlib.sha256(" ".join([p[2] for p in parts]).encode()).hexdigest())
            if with_ids:
                ids.append([i for p in parts for i in p[0]])
        more = [pa.array(ids, pa.list_(pa.int32()))] if with_ids else []
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(n, pa.int64()), pa.array(ids_hash), pa.array(text_hash), *more], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "token_ids"][: 4 + with_ids])

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return over_batches(docs.select("doc_id", "text"), run, schema, keep="bpe")


def query(spark, sf_dir: str) -> DataFrame:
    from .common import documents

    return encode_documents(documents(spark, sf_dir))
