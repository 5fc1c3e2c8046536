"""BPE encoding and decoding with a given vocabulary and merge list."""

from __future__ import annotations

import hashlib
import json
import unicodedata
from heapq import heapify, heappop, heappush

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlight.llm.arrow import map_rows, per_worker

#: White space as Unicode has it; the pre-tokenizer and normalizer of the vocabulary file use it.
SPACE = r"\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
#: Words, and pieces, of which a worker keeps the encoding, per generation.
MEMO = 150_000


class Memo:
    """What was found for a key, in two generations: a full young one becomes the old one, so what is asked for stays."""

    def __init__(self, most: int):
        self.most = most
        self.young: dict = {}
        self.old: dict = {}

    def get(self, key):
        found = self.young.get(key)
        if found is None:
            found = self.old.get(key)
            if found is not None:
                self.put(key, found)
        return found

    def put(self, key, found) -> None:
        if len(self.young) >= self.most:
            self.old, self.young = self.young, {}
        self.young[key] = found


def byte_letters() -> list[str]:
    """The letter for each byte: printable Latin-1 characters stand for themselves, the others for those from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Codec:
    """Encodes as the file's normalizer, pre-tokenizer and merges say; decodes ids to vocabulary strings joined by blanks."""

    def __init__(self, spec: dict):
        import regex

        model = spec["model"]
        self.vocab: dict[str, int] = model["vocab"]
        self.suffix = model.get("end_of_word_suffix") or ""
        self.specials = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.strings = {i: s for s, i in [*self.vocab.items(), *self.specials.items()]}
        self.ranks: dict[int, int] = {}
        self.merged: list[int] = []
        for rank, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[self.vocab[a] << 20 | self.vocab[b]] = rank
            self.merged.append(self.vocab[a + b])
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.pieces = regex.compile(pattern.replace(r"\s", SPACE)).findall
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True))) + ")").split if self.specials else None
        letters = byte_letters()
        self.first = [self.vocab[c] for c in letters]
        self.last = [self.vocab[c + self.suffix] for c in letters]
        self.rank_of = self.ranks.get
        self.digits = {i: str(i) for i in self.strings}
        self.spelled = {str(i): s for i, s in self.strings.items()}
        self.controls = regex.compile("[\x1c-\x1f]").search
        self.by_word = Memo(MEMO)
        self.by_piece = Memo(MEMO)

    def merge(self, piece: str) -> list[int]:
        """Ids of one piece: the pair of least rank, leftmost first, is joined until none is left.

        Symbols are a doubly linked list over places; the queue holds rank * n + place and an
        entry is stale, and skipped, when the pair at its place no longer has that rank.
        """
        raw = piece.encode()
        n = len(raw)
        first = self.first
        ids = [first[b] for b in raw]
        ids[-1] = self.last[raw[-1]]
        rank_of, merged = self.rank_of, self.merged
        queue = []
        for i in range(n - 1):
            rank = rank_of(ids[i] << 20 | ids[i + 1])
            if rank is not None:
                queue.append(rank * n + i)
        if not queue:
            return ids
        heapify(queue)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        while queue:
            entry = heappop(queue)
            rank = entry // n
            i = entry - rank * n
            left, j = ids[i], after[i]
            if left < 0 or j >= n or rank_of(left << 20 | ids[j]) != rank:
                continue
            left = ids[i] = merged[rank]
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                rank = rank_of(left << 20 | ids[k])
                if rank is not None:
                    heappush(queue, rank * n + i)
            h = before[i]
            if h >= 0:
                rank = rank_of(ids[h] << 20 | left)
                if rank is not None:
                    heappush(queue, rank * n + h)
        return [i for i in ids if i >= 0]

    def decode(self, ids: list[int]) -> str:
        return " ".join([self.strings[i] for i in ids])

    def encode(self, text: str) -> list[int]:
        return [int(i) for i in self.ids(text)]

    def told(self, word: str) -> str:
        """The ids, as text, of a stretch of text without special tokens; all that the memos keep of it."""
        known = self.by_word.get(word)
        if known is not None:
            return known
        raw = word
        if not word.isascii():
            word = unicodedata.normalize("NFC", word).replace("Σ", "σ")  # letters are lowered one by one, so no final sigma
        parts = []
        for piece in self.pieces(word.lower()):
            known = self.by_piece.get(piece)
            if known is None:
                known = " ".join([self.digits[i] for i in self.merge(piece)])
                if piece == raw:
                    piece = raw  # one string for both memos
                self.by_piece.put(piece, known)
            parts.append(known)
        found = parts[0] if len(parts) == 1 else " ".join(parts)  # one piece: one string for both memos
        self.by_word.put(raw, found)
        return found

    def section(self, text: str) -> list[str]:
        """Pieces never hold white space, so a text is taken word by word and each word is encoded once."""
        if self.controls(text):  # str.split also parts at these, the vocabulary's white space does not
            return [self.told(text)]
        told, words, found = self.told, text.split(), []
        for at in range(0, len(words), 1000):  # the young generation may be another one after a thousand words
            known = self.by_word.young.get
            found += [known(w) or told(w) for w in words[at : at + 1000]]
        return found

    def ids(self, text: str) -> list[str]:
        """The ids of a text, as decimal numbers."""
        if self.cut is None or "<|" not in text:
            found = self.section(text)
        else:
            found = []
            for section in self.cut(text):
                if section in self.specials:
                    found.append(str(self.specials[section]))
                else:
                    found += self.section(section)
        return " ".join(found).split()


def codec(path: str) -> Codec:
    with open(path, encoding="utf-8") as file:
        return Codec(json.load(file))


def encode_documents(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",), texts: bool = False) -> DataFrame:
    """Adds to the columns ``keep``: n_tokens, ids_sha256, decoded_sha256, and with ``texts`` the ids and the decoded text.

    The digests are of the decimal ids joined by blanks and of the decoded text, in UTF-8. Null and
    empty texts have no ids. Each row is by itself, so ties and repeated rows are equal; other columns are
    not read. ``path`` is the vocabulary file, which every worker opens.
    """
    types = dict(docs.dtypes)
    kept = [f"k{i}" for i in range(len(keep))]  # names of their own, whatever the columns are called
    made = ["n_tokens long", "ids_sha256 string", "decoded_sha256 string", *(["ids array<int>", "decoded string"] if texts else [])]

    def make():
        coder = per_worker(f"codec of {path}", lambda: codec(path))
        spelled = coder.spelled

        def work(columns: dict[str, list]) -> dict[str, list]:
            out: dict[str, list] = {k: columns[k] for k in kept} | {c: [] for c in ("n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded")}
            for text in columns["text"]:
                ids = coder.ids(text or "")
                decoded = " ".join([spelled[i] for i in ids])
                out["n_tokens"].append(len(ids))
                out["ids_sha256"].append(hashlib.sha256(" ".join(ids).encode()).hexdigest())
                out["decoded_sha256"].append(hashlib.sha256(decoded.encode()).hexdigest())
                if texts:
                    out["ids"].append([int(i) for i in ids])
                    out["decoded"].append(decoded)
            return out

        return work

    rows = docs.select(*[F.col(f"`{c}`").alias(k) for k, c in zip(kept, keep)], F.col("text").alias("text"))
    done = map_rows(rows, make, ", ".join([*(f"{k} {types[c]}" for k, c in zip(kept, keep)), *made]), keeps=True)
    return done.select(*[F.col(k).alias(c) for k, c in zip(kept, keep)], *[m.split()[0] for m in made])
