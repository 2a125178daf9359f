"""BPE encoding by a depth-first walk over a trie of distinct words.

In a BPE vocabulary a string is encoded as a token sequence exactly if every
token encodes to itself and no merge of the training order would have crossed
the border of two neighbouring tokens. So the last token of a prefix, together
with the last tokens of its shorter prefixes, gives its whole encoding. The
distinct words of a batch, sorted, are a trie in depth-first order: the walk
keeps the last token of every prefix on its path, and a word starts from the
states of the prefix it shares with the word before.

Documents are independent: nothing is shuffled, a task holds the words of one
batch and a bounded cache. Null and empty texts have no tokens; ids may be null
or repeat; other columns are not read.
"""

import hashlib
import json
import re
import unicodedata
from functools import lru_cache
from os.path import commonprefix

import pyarrow as pa
from pyspark.sql import DataFrame

# Entries of each table that a task keeps between walks.
CACHED = 200_000
# Texts of these characters are split by a character class; others by the file's
# own normalizer and splitter, whose tables of letters may be of another version.
_LATIN = 0x180
_PLAIN = re.compile("[\x00-\u017f\u2010-\u2027\u2030-\u205e]*")
_NEVER = 1 << 30


def _char_class(kind: str, upto: int = _LATIN) -> str:
    found = [c for c in map(chr, range(upto)) if unicodedata.category(c)[0] == kind]
    return "".join(map(re.escape, found))


def byte_chars() -> list[str]:
    """The printable stand-ins of the 256 bytes in byte-level vocabularies: a
    printable Latin byte is itself, the others follow from code point 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    spare = iter(range(256, 512))
    return [chr(b if b in plain else next(spare)) for b in range(256)]


class WordBpe:
    """Encoder of a tokenizers file of the kind BPE with a word-end suffix."""

    def __init__(self, text: str):
        spec = json.loads(text)
        model = spec["model"]
        self.end = model["end_of_word_suffix"] or ""
        self.vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.special.items()]}
        self.parts: dict[int, tuple[int, int, int]] = {}
        self.rank: dict[tuple[int, int], int] = {}
        for n, merge in enumerate(model["merges"]):
            a, b = (self.vocab[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.rank[a, b] = n
            self.parts[self.vocab[self.strings[a] + self.strings[b]]] = (a, b, n)
        self._spines: tuple[dict, dict] = ({}, {})
        self._pairs: dict[tuple[int, int], bool] = {}
        for token, (a, b, n) in self.parts.items():
            if self._crossed(a, b, n):
                raise ValueError(f"{self.strings[token]!r} does not encode to itself")
        self.length = {i: len(s.removesuffix(self.end)) for s, i in self.vocab.items()}
        bare = {s.removesuffix(self.end) for s in self.vocab}
        self.prefixes = {s[:k] for s in bare for k in range(1, len(s) + 1)}
        self._states: dict[str, tuple[str, tuple, tuple]] = {}
        self.back = {ord(c): b for b, c in enumerate(byte_chars())}
        self.table = {b: c for b, c in enumerate(byte_chars()) if chr(b) != c}
        self.pattern_plain = re.compile(
            rf"'s|'t|'re|'ve|'m|'ll|'d|[{_char_class('L')}]+|[{_char_class('N')}]"
            rf"|[^\t-\r \x85\xa0{_char_class('L')}{_char_class('N')}]+"
        )
        self.split_special = re.compile("(" + "|".join(map(re.escape, self.special)) + ")")
        from tokenizers import Tokenizer

        whole = Tokenizer.from_str(text)
        self.normalizer, self.splitter = whole.normalizer, whole.pre_tokenizer
        self.ids: dict[str, bytes] = {}
        self.decoded: dict[str, bytes] = {}

    # --- merges ----------------------------------------------------------

    def _spine(self, token: int, side: int) -> list[tuple[int, int, int]]:
        """The pieces that stand at one edge of a token while it is built, last
        first: (piece, rank at which it is formed, rank at which it is used)."""
        found = self._spines[side].get(token)
        if found is None:
            found, piece, used = [], token, _NEVER
            while True:
                made = self.parts.get(piece)
                found.append((piece, made[2] if made else -1, used))
                if not made:
                    break
                piece, used = made[side], made[2]
            self._spines[side][token] = found
        return found

    def _crossed(self, a: int, b: int, before: int = _NEVER) -> bool:
        """Whether a merge of rank under `before` crosses the border of a and b.
        At equal rank the merge further left comes first."""
        for x, made_x, used_x in self._spine(a, 1):
            for y, made_y, used_y in self._spine(b, 0):
                n = self.rank.get((x, y), _NEVER)
                if n < before and made_x < n < used_x and made_y < n <= used_y:
                    return True
        return False

    # --- the walk --------------------------------------------------------

    def _enter(self, text: str) -> tuple[str, tuple, tuple]:
        """The longest end of `text` that begins a token; the tokens that end
        there as (token, characters), longest first; the same for word ends."""
        found = self._states.get(text)
        if found is None:
            state = next((text[k:] for k in range(len(text)) if text[k:] in self.prefixes), "")
            ends = [state[k:] for k in range(len(state))]
            inner = tuple((self.vocab[x], len(x)) for x in ends if x in self.vocab)
            final = tuple((self.vocab[x + self.end], len(x)) for x in ends if x + self.end in self.vocab)
            found = self._states[text] = (state, inner, final)
        return found

    def _last(self, at: int, tokens: tuple, last: list[int]) -> int:
        """The last token of a prefix of `at` characters: the one of the tokens
        ending there that may follow the last token of what is before it."""
        pairs = self._pairs
        for token, size in tokens:
            if size == at:
                return token
            key = (last[at - size], token)
            ok = pairs.get(key)
            if ok is None:
                ok = pairs[key] = not self._crossed(*key)
            if ok:
                return token
        raise ValueError("no token ends here")

    def walk(self, words: list[str]):
        """(word, its tokens) over sorted distinct words of byte characters."""
        last, states, finals, before = [-1], [""], [()], ""
        length, known = self.length, self._states
        for word in words:
            shared = len(commonprefix((before, word)))
            del last[shared + 1 :], states[shared + 1 :], finals[shared + 1 :]
            for at in range(shared, len(word)):
                text = states[at] + word[at]
                state, inner, final = known.get(text) or self._enter(text)
                last.append(self._last(at + 1, inner, last))
                states.append(state)
                finals.append(final)
            at = len(word)
            tokens = [self._last(at, finals[at], last)]
            at -= length[tokens[0]]
            while at:
                tokens.append(last[at])
                at -= length[last[at]]
            yield word, tokens[::-1]
            before = word

    # --- texts -----------------------------------------------------------

    def split(self, text: str) -> list[str]:
        if _PLAIN.fullmatch(text) and unicodedata.is_normalized("NFC", text):
            return self.pattern_plain.findall(text.lower())
        found = self.splitter.pre_tokenize_str(self.normalizer.normalize_str(text))
        return [w.translate(self.back).encode("latin-1").decode() for w, _ in found]

    def pieces(self, text: str | None) -> list[str]:
        """The words of a text; special tokens stand for themselves."""
        text = text or ""
        if "<|" not in text:
            return self.split(text)
        found = []
        for k, part in enumerate(self.split_special.split(text)):
            found += ["\0" + part] if k % 2 else self.split(part)
        return found

    def _learn(self, words: set[str]) -> None:
        """Encode words into the cache."""
        new = {}
        for w in words:
            if w[0] == "\0" and w[1:] in self.special:
                self._keep(w, [self.special[w[1:]]])
            else:
                new[w if w.isascii() and w.isprintable() else w.encode().decode("latin-1").translate(self.table)] = w
        for word, tokens in self.walk(sorted(new)):
            self._keep(new[word], tokens)

    def _keep(self, word: str, tokens: list[int]) -> None:
        self.ids[word] = b"".join([t.to_bytes(4, "little") for t in tokens])
        self.decoded[word] = " ".join([self.strings[t] for t in tokens]).encode()

    def forget(self) -> None:
        for table in (self.ids, self.decoded, self._pairs, self._states, *self._spines):
            table.clear()

    def encode_batch(self, texts: list[str | None]) -> list[tuple[bytes, bytes]]:
        """(ids as little-endian 32-bit integers, decoded text) of each text."""
        split = [self.pieces(t) for t in texts]
        new = set().union(*split)
        if len(self.ids) > CACHED:
            self.ids.clear()
            self.decoded.clear()
        for table in (self._pairs, self._states):
            if len(table) > CACHED:
                table.clear()
        self._learn(new.difference(self.ids))
        ids, decoded = self.ids.__getitem__, self.decoded.__getitem__
        return [(b"".join(map(ids, words)), b" ".join(map(decoded, words))) for words in split]


@lru_cache(maxsize=1)
def load(text: str) -> WordBpe:
    return WordBpe(text)


def read_tokenizer(path: str) -> str:
    with open(path, encoding="utf-8") as f:
        return f.read()


def encode(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, tokens array<int>, decoded string) of every document. `tokenizer` is
    the content of a tokenizers file; a vocabulary is of fixed size."""
    import numpy as np

    def row(ids: bytes, decoded: bytes):
        return np.frombuffer(ids, "<u4").astype("int32"), decoded.decode()

    def columns(found):
        rows = [row(*f) for f in found]
        return [pa.array([r[0] for r in rows], pa.list_(pa.int32())), pa.array([r[1] for r in rows], pa.string())]

    return _map(docs, tokenizer, id_col, text_col, columns, "tokens array<int>, decoded string")


def digests(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, n_tokens, ids_sha256, decoded_sha256) of every document."""

    def columns(found):
        return [
            pa.array([len(ids) // 4 for ids, _ in found], pa.int64()),
            pa.array([hashlib.sha256(ids).hexdigest() for ids, _ in found], pa.string()),
            pa.array([hashlib.sha256(text).hexdigest() for _, text in found], pa.string()),
        ]

    return _map(docs, tokenizer, id_col, text_col, columns, "n_tokens long, ids_sha256 string, decoded_sha256 string")


# Texts encoded together: their distinct words share one walk.
_CHARS_PER_WALK = 2_000_000


def _map(docs: DataFrame, tokenizer: str, id_col: str, text_col: str, columns, schema: str) -> DataFrame:
    spec = docs.sparkSession.sparkContext.broadcast(tokenizer)

    def run(batches):
        model = load(spec.value)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            start, chars = 0, 0
            for k in range(len(texts)):
                chars += len(texts[k].as_py() or "")
                if chars >= _CHARS_PER_WALK or k == len(texts) - 1:
                    part = texts.slice(start, k + 1 - start).to_pylist()
                    got = columns(model.encode_batch(part))
                    yield pa.RecordBatch.from_arrays([ids.slice(start, k + 1 - start), *got], names=names)
                    start, chars = k + 1, 0
        # the worker may go on to other work
        model.forget()

    names = [id_col, *[c.split()[0] for c in schema.split(", ")]]
    kind = docs.schema[id_col].dataType.simpleString()
    return docs.select(id_col, text_col).mapInArrow(run, f"{id_col} {kind}, {schema}")
