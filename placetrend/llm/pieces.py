"""Encoding into and decoding from the pieces of a SentencePiece BPE model, in streaming fashion."""

from __future__ import annotations

import functools
import re
from array import array
from collections.abc import Callable, Iterator
from operator import add

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from placetrend.llm.shared import small

MARK = "▁"
#: Marks, then other characters: no piece but a run of marks has a mark behind its first character.
STRETCH = re.compile(f"{MARK}+[^{MARK}]*|[^{MARK}]+")
#: Where the first mark of a run stands.
FIRST_MARK = re.compile(f"(?<!{MARK}){MARK}")
#: Characters of a text whose stretches are listed at once.
PART_CHARS = 1 << 16
#: Short stretches and units of them, in each of two generations, whose ids a worker keeps; those not met
#: again while a generation fills are worked out anew.
KEPT_STRETCHES = 1 << 17
#: Pairs of pieces whose answer a worker keeps.
KEPT_PAIRS = 1 << 19


class Kept(dict):
    """Ids of strings, by ``code`` where they are missing, which may add them."""

    def __init__(self, code: Callable[[str], bytes]):
        self.code = code

    def __missing__(self, text: str) -> bytes:
        return self.code(text)


def _parts_of(marked: str) -> Iterator[str]:
    """``marked`` in parts of about ``PART_CHARS`` characters; no stretch is cut."""
    at = 0
    while len(marked) - at > PART_CHARS and (found := FIRST_MARK.search(marked, at + PART_CHARS)):
        yield marked[at : found.start()]
        at = found.start()
    yield marked[at:]


class PieceModel:
    """A streaming left-to-right search over a BPE piece table.

    Merges by score do not yield the path of the greatest sum, so the step of the search differs
    from that of a unigram model: of the pieces that end at a position, the survivor is the one
    that the merges leave unmerged beside the piece that survived where it starts. Exactly one does,
    and the survivors' back pointers are the model's own segmentation of every prefix.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        size = model.get_piece_size()
        kinds = {k: (model.is_control(k), model.is_unknown(k), model.is_byte(k)) for k in range(size)}
        self.names = [model.id_to_piece(k) for k in range(size)]
        self.ids = {self.names[k]: k for k in range(size) if not any(kinds[k])}
        self.scores = {name: model.get_score(k) for name, k in self.ids.items()}
        self.byte_ids = {int(self.names[k][1:-1], 16): k for k in range(size) if kinds[k][2]}
        self.unknown = model.unk_id()
        self.longest = max(map(len, self.ids), default=1)
        inner = [p for p in self.ids if MARK in p[1:] and p.strip(MARK)]
        if inner or model.encode("a  b\n", out_type=str)[0][0] != MARK:
            raise ValueError("only models that split at white space and keep all of it are supported")
        #: Characters side by side in some piece. No piece and no merge reaches over any other two, so what
        #: lies between such places is coded by itself.
        self.joined = {a + b for piece in self.ids for a, b in zip(piece, piece[1:], strict=False)}
        #: A tree of the pieces' characters: what may follow, and the piece that ends here, if any.
        self.tree: dict = {}
        for piece in self.ids:
            after = self.tree
            for c in piece:
                node = after.setdefault(c, [{}, None])
                after = node[0]
            node[1] = piece
        control = {k for k in range(size) if kinds[k][0]}
        raw = {k: b"" if k in control else self.names[k].replace(MARK, " ").encode() for k in range(size)}
        raw |= {k: bytes([b]) for b, k in self.byte_ids.items()} | {self.unknown: " ⁇ ".encode()}
        self.raw = [raw[k] for k in range(size)]
        self.pairs: dict[str, dict[str, bool]] = {}
        self.n_pairs = 0
        self.stretches = Kept(self._coded)
        self.older: dict[str, bytes] = {}

    def _merged(self, text: str) -> list[str]:
        """The pieces that the merges leave of a short string: best score first, then leftmost."""
        parts = list(text)
        while True:
            best, at = None, -1
            for k in range(len(parts) - 1):
                score = self.scores.get(parts[k] + parts[k + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, k
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def _stands(self, left: str, right: str) -> bool:
        """Whether the merges leave ``left`` and ``right`` as they are beside each other."""
        self.n_pairs += 1
        return self._merged(left + right) == ([left, right] if left else [right])

    def _emit(self, piece: str, out: array) -> None:
        known = self.ids.get(piece)
        if known is not None:
            out.append(known)
        elif self.byte_ids:
            out.extend(self.byte_ids[b] for b in piece.encode())
        else:
            out.append(self.unknown)

    def _search(self, text: str, out: array) -> None:
        """Append the ids of one stretch.

        A piece that starts at a position can only follow the survivor there, and reaches ``longest``
        characters at most. Once the back pointers of all survivors that later pieces can follow have
        come through one boundary, the ids before it are committed and forgotten, so a stretch of any
        length needs a window of a few times ``longest``.
        """
        tree, longest, pairs = self.tree, self.longest, self.pairs
        base, last = 0, [""] + [None] * len(text[: 9 * longest])  # last[k]: the survivor that ends at base + k
        for at in range(len(text)):
            if at - base > 8 * longest and (shared := self._meeting(last, at - base)):
                for piece in self._path(last, shared):
                    self._emit(piece, out)
                del last[:shared]
                base += shared
            here = at - base
            left = last[here]
            known = pairs.get(left)
            if known is None:
                known = pairs[left] = {}
            if len(last) <= here + longest:
                last.extend([None] * longest)
            after, end = tree, here
            for c in text[at : at + longest]:
                node = after.get(c)
                if node is None:
                    break
                end += 1
                after, right = node
                if right is not None:
                    stands = known.get(right)
                    if stands is None:
                        stands = known[right] = self._stands(left, right)
                    if stands:
                        last[end] = right
            if last[here + 1] is None:  # no piece ends there: the character is unknown
                last[here + 1] = text[at]
        for piece in self._path(last, len(text) - base):
            self._emit(piece, out)

    def _meeting(self, last: list[str], at: int) -> int:
        """The latest boundary that the paths of all survivors in reach at ``at`` have in common."""
        shared: set[int] | None = None
        for end in range(at, len(last)):
            if end == at or last[end]:
                path = set()
                while end > 0:
                    path.add(end)
                    end -= len(last[end])
                shared = path if shared is None else shared & path
        return max(shared, default=0)

    @staticmethod
    def _path(last: list[str], at: int) -> Iterator[str]:
        found = []
        while at > 0:
            found.append(last[at])
            at -= len(last[at])
        return reversed(found)

    def _units(self, stretch: str) -> list[str]:
        """``stretch``, cut between characters that no piece has side by side."""
        joined = self.joined
        cuts = [k for k, pair in enumerate(map(add, stretch, stretch[1:]), 1) if pair not in joined]
        return [stretch[a:b] for a, b in zip([0, *cuts], [*cuts, len(stretch)], strict=True)] if cuts else [stretch]

    def _coded(self, stretch: str) -> bytes:
        """The ids of a stretch or unit that the newer generation lacks; it has them then, if that is short."""
        known, older = self.stretches, self.older
        ids = older.get(stretch)
        if ids is None:
            units = self._units(stretch)
            if len(units) > 1:
                ids = b"".join([known[unit] for unit in units])
            else:
                found = array("i")
                self._search(stretch, found)
                ids = found.tobytes()
        if len(stretch) <= 64:
            known[stretch] = ids
        return ids

    def encode(self, text: str) -> array:
        """Ids of ``text``, without begin and end; an empty text has none."""
        out = array("i")
        if text:
            for part in _parts_of(MARK + text.replace(" ", MARK)):
                if len(self.stretches) >= KEPT_STRETCHES:
                    self.older, self.stretches = dict(self.stretches), Kept(self._coded)
                if self.n_pairs >= KEPT_PAIRS:
                    self.pairs.clear()
                    self.n_pairs = 0
                out.frombytes(b"".join(map(self.stretches.__getitem__, STRETCH.findall(part))))
        return out

    def decode(self, ids: array) -> str:
        """The text of ``ids``. The mark itself decodes as a space, bytes that are no UTF-8 as U+FFFD."""
        raw = self.raw
        return b"".join(map(raw.__getitem__, ids)).decode("utf-8", "replace").removeprefix(" ")


@functools.cache
def model_for(path: str) -> PieceModel:
    return PieceModel(path)


def _batches_of(texts: list[str], size: int = 4 << 20) -> Iterator[tuple[int, int]]:
    start = total = 0
    for k, text in enumerate(texts):
        if k > start and total + len(text) > size:
            yield start, k
            start, total = k, 0
        total += len(text)
    yield start, len(texts)


def encode_texts(docs: DataFrame, path: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row per row of ``docs``: ``doc_id``, ``n_tokens``, ``ids``, ``round_trip``.

    ``ids`` equal the library's for the whole text, without begin and end. ``round_trip`` says
    whether decoding them gives the text back; it is false only for texts that hold the mark U+2581
    or, in a model without byte pieces, an unknown character. A null text counts as empty: no id, and
    it round-trips to the empty text. Null ids stay, repeated rows give repeated rows, other columns
    are not read. ``path`` must name the same file on every executor. Nothing is shuffled.
    """

    def run(batches):
        model = model_for(path)
        for batch in small(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for a, b in _batches_of(texts):
                coded = [model.encode(t) for t in texts[a:b]]
                same = [model.decode(c) == t for c, t in zip(coded, texts[a:b], strict=True)]
                ends, flat = array("i", [0]), array("i")
                for c in coded:
                    flat.extend(c)
                    ends.append(len(flat))
                ids = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.Array.from_buffers(pa.int32(), len(flat), [None, pa.py_buffer(flat)]))
                sizes = pa.array([len(c) for c in coded], pa.int64())
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a), sizes, ids, pa.array(same, pa.bool_())], ["doc_id", "n_tokens", "ids", "round_trip"]
                )

    kind = docs.schema[id_column].dataType.simpleString()
    return docs.select(F.col(id_column).alias("doc_id"), text_column).mapInArrow(
        run, f"doc_id {kind}, n_tokens bigint, ids array<int>, round_trip boolean"
    )


def decode_ids(coded: DataFrame, path: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``doc_id, text`` from ids. Null ids give a null text; null entries are skipped."""

    def run(batches):
        model = model_for(path)
        for batch in small(batches):
            texts = [None if x is None else model.decode([k for k in x if k is not None]) for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], ["doc_id", "text"])

    kind = coded.schema[id_column].dataType.simpleString()
    return coded.select(F.col(id_column).alias("doc_id"), ids_column).mapInArrow(run, f"doc_id {kind}, text string")
