"""SentencePiece encoding and decoding of merge-type (BPE) models, without the library on the rows' path.

Method: prefix table. Every prefix of a text has one last token in its own encoding. A vocabulary automaton
lists the pieces that end at a position; the last token is the one piece whose predecessor - the last token of
the prefix before it - would not have merged across their border. That test (`_Pairs`) replays both pieces'
border symbols in merge order. The ids are then read backwards from the end of the table. It takes time linear
in the text, however long, and gives the library's ids.

No piece spans a border between a blank and the character before it, nor a character outside the vocabulary,
so a text is cut there; equal cuts are encoded once per task (a bounded memo).

Rows: null text counts as empty; the empty text has the end id alone and decodes to ''. Repeated rows repeat;
an empty table gives an empty table. Other columns of the input are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import send_fewer_texts, tidied

#: What SentencePiece writes for a blank.
BLANK = "▁"
#: Cuts that one task keeps encoded in each of two generations; when the young one is full, it becomes the old one.
MEMO = 100_000
#: Border tests that one task keeps.
PAIR_MEMO = 250_000
#: Longer cuts are not kept.
MEMO_CHARS = 48


def read_model(model_file: str) -> dict:
    """Pieces, merge ranks and end id of a BPE model with byte fallback; small, so that it can travel with tasks."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=model_file)
    pieces, byte_ids = {}, [0] * 256
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i):
            byte_ids[int(piece[3:5], 16)] = i
        elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
            pieces[piece] = (i, model.get_score(i))
    return {"pieces": pieces, "bytes": byte_ids, "end": model.eos_id()}


class PrefixEncoder:
    def __init__(self, model: dict):
        pieces = model["pieces"]
        self.end, self.byte_ids = model["end"], model["bytes"]
        self.text_of = {i: p.replace(BLANK, " ") for p, (i, _) in pieces.items()}
        blanks = {len(p): i for p, (i, _) in pieces.items() if not p.strip(BLANK)}
        # Runs of blanks share one lowest score: they merge last, from the left, into the longest piece there is.
        self.blank_ids, self.longest_blank = blanks, max(blanks)
        order = sorted((p for p in pieces if len(p) > 1 and p.strip(BLANK)), key=lambda p: (-pieces[p][1], pieces[p][0]))
        self.rank = {p: r for r, p in enumerate(order)}
        self.split: dict[str, tuple[str, str]] = {}
        for p in order:
            if parts := self._last_merge(p):
                self.split[p] = parts
        self.chars = {p for p in pieces if len(p) == 1}
        self.id_of = {p: i for p, (i, _) in pieces.items()}
        self.automaton = ahocorasick.Automaton()
        for p in [*self.chars, *self.split]:
            self.automaton.add_word(p, self.id_of[p])
        self.piece_of = {i: p for p, i in self.id_of.items()}
        self.size = [len(self.piece_of.get(i, "")) for i in range(max(self.piece_of) + 1)]
        self.automaton.make_automaton()
        self.known: dict[int, bool] = {}
        self.right_spine: dict[str, list[tuple[int, str]]] = {}
        self.left_spine: dict[str, list[tuple[int, str]]] = {}
        self.outside = re.compile("([^" + re.escape("".join(sorted(self.chars))) + "])")
        self.memo: dict[str, str] = {}
        self.old: dict[str, str] = {}
        self.byte_of = {i: b for b, i in enumerate(self.byte_ids)}

    def _last_merge(self, piece: str) -> tuple[str, str] | None:
        """The two symbols whose merge makes the piece, or None if merging its characters never makes it."""
        parts = list(piece)
        while len(parts) > 2:
            ranked = [(r, k) for k in range(len(parts) - 1) if (r := self.rank.get(parts[k] + parts[k + 1])) is not None]
            if not ranked:
                return None
            k = min(ranked)[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return (parts[0], parts[1]) if len(parts) == 2 else None

    def _spine(self, piece: str, side: int) -> list[tuple[int, str]]:
        """The symbols that stand at one border of the piece as it grows, each with the time at which it appears."""
        chain = [piece]
        while len(chain[-1]) > 1:
            chain.append(self.split[chain[-1]][side])
        out, time = [], -1
        for symbol in reversed(chain):
            time = max(time, self.rank.get(symbol, -1))
            out.append((time, symbol))
        return out

    def fits(self, left: int, right: int) -> bool:
        """Whether merging leaves a border between the two pieces (ids)."""
        left_piece, right_piece = self.piece_of[left], self.piece_of[right]
        a = self.right_spine.get(left_piece) or self.right_spine.setdefault(left_piece, self._spine(left_piece, 1))
        b = self.left_spine.get(right_piece) or self.left_spine.setdefault(right_piece, self._spine(right_piece, 0))
        never = len(self.rank) + 1
        i = j = 0
        while True:
            next_a = a[i + 1][0] if i + 1 < len(a) else never
            next_b = b[j + 1][0] if j + 1 < len(b) else never
            across = self.rank.get(a[i][1] + b[j][1], never)
            # Of equal ranks the leftmost merges first: the left piece's own, then the one across, then the right piece's.
            if across < next_a and across <= next_b and across < never:
                return False
            if next_a == never and next_b == never:
                return True
            if next_a <= next_b:
                i += 1
            else:
                j += 1

    def pieces(self, cut: str) -> list[int]:
        """The ids of a text of vocabulary characters that has no two blanks in a row."""
        last = [-1] * (len(cut) + 1)
        known, size, ids = self.known, self.size, []
        for end, piece in self.automaton.iter(cut):  # longest first at each end
            end += 1
            if last[end] < 0:
                at = end - size[piece]
                if not at:
                    last[end] = piece
                    continue
                before = last[at]
                if before >= 0:
                    key = before << 32 | piece
                    ok = known.get(key)
                    if ok is None:
                        if len(known) > PAIR_MEMO:
                            known.clear()
                        ok = known[key] = self.fits(before, piece)
                    if ok:
                        last[end] = piece
        at = len(cut)
        while at:
            piece = last[at]
            ids.append(piece)
            at -= size[piece]
        ids.reverse()
        return ids

    def _ids(self, cut: str) -> list[int]:
        if self.outside.search(cut) is None:
            return self.pieces(cut)
        ids: list[int] = []
        for k, part in enumerate(self.outside.split(cut)):
            if k % 2:
                ids += [self.byte_ids[b] for b in part.encode()]
            elif part:
                ids += self.pieces(part)
        return ids

    def _text(self, ids: list[int]) -> str:
        """What the ids decode to: pieces are text, runs of byte ids are UTF-8."""
        out, pending = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                pending.append(self.byte_of[i])
                continue
            if pending:
                out.append(pending.decode("utf-8", "replace"))
                pending.clear()
            out.append(self.text_of[i])
        return "".join(out) + pending.decode("utf-8", "replace")

    def _entry(self, cut: str) -> str:
        """Decimal ids of a cut. They must decode to the cut, so that the decoded text is the joined cuts."""
        ids = self._ids(cut.replace(" ", BLANK))
        try:
            text = "".join([self.text_of[i] for i in ids])
        except KeyError:
            text = self._text(ids)
        if text != cut:
            raise ValueError(f"ids of {cut!r} decode to {text!r}")
        return " ".join(map(str, ids))

    def _blank_run(self, n: int) -> str:
        ids = []
        while n:
            take = min(n, self.longest_blank)
            while take not in self.blank_ids:
                take -= 1
            ids.append(self.blank_ids[take])
            n -= take
        return " ".join(map(str, ids))

    #: A cut starts at a blank that follows something else; line ends stand alone, as they are outside the vocabulary.
    CUTS = re.compile(" ?[^ \n]+|\n| ")

    def encode(self, text: str | None) -> tuple[str, str]:
        """(decimal ids joined by one blank, the end id last; what they decode to)."""
        if not text:
            return str(self.end), ""
        cuts = self.CUTS.findall(" " + text.replace(BLANK, " "))
        memo = self.memo
        missing = set(cuts).difference(memo)
        long = {}
        if missing:
            if len(memo) + len(missing) > MEMO:
                self.old, self.memo = memo, {}
                memo, missing = self.memo, set(cuts)
            old = self.old
            for cut in missing:
                (memo if len(cut) <= MEMO_CHARS else long)[cut] = old.get(cut) or self._entry(cut)
        if " " in missing or " " in memo and " " in cuts:
            parts = list(self._with_runs(cuts, memo | long if long else memo))
        elif long:
            parts = [memo.get(c) or long[c] for c in cuts]
        else:
            parts = [memo[c] for c in cuts]
        parts.append(str(self.end))
        return " ".join(parts), "".join(cuts)[1:]

    def _with_runs(self, cuts: list[str], entries: dict[str, str]) -> Iterator[str]:
        """Ids where some cuts are single blanks; a blank that its word left alone joins the run before it."""
        lone, blank = str(self.id_of[BLANK]), 0
        for cut in cuts:
            if cut == " ":
                blank += 1
                continue
            ids = entries[cut]
            if blank:
                if cut[0] == " " and (ids == lone or ids.startswith(lone + " ")):
                    blank, ids = blank + 1, ids[len(lone) + 1 :]
                yield self._blank_run(blank)
                blank = 0
            if ids:
                yield ids
        if blank:
            yield self._blank_run(blank)


_ENCODERS: dict[str, PrefixEncoder] = {}


def _encoder(key: str, model: Callable[[], dict]) -> PrefixEncoder:
    if key not in _ENCODERS:  # a Python worker serves many tasks
        _ENCODERS.clear()
        _ENCODERS[key] = PrefixEncoder(model())
    return _ENCODERS[key]


def encode_documents(docs: DataFrame, model_file: str, id_col: str = "doc_id", text_col: str = "text", keep_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256, and with keep_ids also the ids and the decoded text.

    One narrow pass: no shuffle, and memory bounded by the memo and the longest text.
    """
    send_fewer_texts(docs.sparkSession)
    key = f"{model_file}"
    model = docs.sparkSession.sparkContext.broadcast(read_model(model_file))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoder(key, lambda: model.value)
        for batch in batches:
            n, ids_sha, text_sha, ids, decoded = [], [], [], [], []
            for value in batch.column(1):
                joined, text = encoder.encode(value.as_py())
                n.append(joined.count(" ") + 1)
                ids_sha.append(hashlib.sha256(joined.encode("ascii")).hexdigest())
                text_sha.append(hashlib.sha256(text.encode()).hexdigest())
                if keep_ids:
                    ids.append([int(x) for x in joined.split(" ")])
                    decoded.append(text)
            columns = [batch.column(0), pa.array(n, pa.int64()), pa.array(ids_sha, pa.string()), pa.array(text_sha, pa.string())]
            names = [id_col, "n_tokens", "ids_sha256", "decoded_sha256"]
            if keep_ids:
                columns += [pa.array(ids, pa.list_(pa.int32())), pa.array(decoded, pa.string())]
                names += ["ids", "decoded"]
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = f"`{id_col}` {id_type}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>, decoded string" * keep_ids
    return docs.select(id_col, text_col).mapInArrow(tidied(run), schema)
