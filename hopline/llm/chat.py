"""Chat formatting: typed content parts flattened by a visitor into one marked-up turn.

A turn's content is plain text or a list of typed parts. A part is a dict with a
``type``: ``text`` (``text``), ``image`` (``url``, ``width``, ``height``), ``audio``
(``url``, ``seconds``) or ``document`` (``url``, ``pages``). The visitor walks them in
order, writes text escaped, writes every other part as a placeholder, and records the
attachment together with the number of tokens its placeholder will expand to.

The template marks each turn on its own::

    [INST:role]text[/INST]          for every role but the assistant
    [ANS]text</s>                   for the assistant

Inside texts and roles each of the characters ``[``, ``]``, ``<``, ``>`` and ``\\`` gets a
backslash before it, so no text can form a mark and unescaping gives the text back.
"""

from __future__ import annotations

import hashlib
import json
import math
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SPECIAL = re.compile(r"[\[\]<>\\]")
ESCAPED = re.compile(r"\\(.)", re.S)
PIECE = re.compile(r"\[ANS\]((?:[^\\\[\]<>]|\\.)*)</s>|\[INST:((?:[^\\\[\]<>]|\\.)*)\]((?:[^\\\[\]<>]|\\.|<(?:image|audio|document):\d+>)*)\[/INST\]", re.S)


def escape(text: str) -> str:
    return SPECIAL.sub(lambda m: "\\" + m[0], text)


def unescape(text: str) -> str:
    return ESCAPED.sub(r"\1", text)


@dataclass(frozen=True)
class TokenCosts:
    """How many tokens a placeholder expands to."""

    image_patch: int = 28
    audio_per_second: int = 25
    document_page: int = 512


@dataclass
class PartVisitor:
    """Flattens parts in order; unknown types and broken parts become their JSON as text."""

    costs: TokenCosts = field(default_factory=TokenCosts)
    pieces: list[str] = field(default_factory=list)
    attachments: list[tuple[str, str, int]] = field(default_factory=list)

    def visit(self, part) -> None:
        if isinstance(part, str):
            part = {"type": "text", "text": part}
        kind = part.get("type") if isinstance(part, dict) else None
        handler = getattr(self, f"visit_{kind}", None) if isinstance(kind, str) else None
        if handler is None:
            self.visit_text({"text": json.dumps(part, ensure_ascii=False, sort_keys=True)})
        else:
            handler(part)

    def visit_text(self, part: dict) -> None:
        self.pieces.append(escape(_string(part.get("text"))))

    def visit_image(self, part: dict) -> None:
        rows = math.ceil(_number(part.get("height")) / self.costs.image_patch)
        columns = math.ceil(_number(part.get("width")) / self.costs.image_patch)
        self._attach("image", part, max(1, rows * columns))

    def visit_audio(self, part: dict) -> None:
        self._attach("audio", part, max(1, math.ceil(_number(part.get("seconds")) * self.costs.audio_per_second)))

    def visit_document(self, part: dict) -> None:
        self._attach("document", part, max(1, math.ceil(_number(part.get("pages")) * self.costs.document_page)))

    def _attach(self, kind: str, part: dict, tokens: int) -> None:
        self.pieces.append(f"<{kind}:{len(self.attachments)}>")
        self.attachments.append((kind, _string(part.get("url")), tokens))


def _string(value) -> str:
    return "" if value is None else value if isinstance(value, str) else json.dumps(value)


def _number(value) -> float:
    ok = isinstance(value, (int, float)) and not isinstance(value, bool) and math.isfinite(value)
    return max(0.0, float(value)) if ok else 0.0


def flatten(content: str | list | None, costs: TokenCosts = TokenCosts()) -> PartVisitor:
    visitor = PartVisitor(costs)
    for part in [content or ""] if not isinstance(content, list) else content:
        visitor.visit(part)
    return visitor


def render(role: str, content: str | list | None, costs: TokenCosts = TokenCosts()) -> tuple[str, int, int, list]:
    """The formatted turn, the loss span inside it (code points) and its attachments.

    The loss covers what an assistant wrote, without the marks; other roles have
    an empty span. An assistant's attachments are placeholders and carry no loss:
    they come after the span.
    """
    visitor = flatten(content, costs)
    body = "".join(visitor.pieces)
    if role == "assistant" and not visitor.attachments:
        return f"[ANS]{body}</s>", 5, 5 + len(body), []
    return f"[INST:{escape(role)}]{body}[/INST]", 0, 0, visitor.attachments


def read_back(formatted: str) -> list[tuple[str, str, bool]]:
    """(role, text, under loss) of every turn of a formatted conversation."""
    turns, at = [], 0
    for m in PIECE.finditer(formatted):
        if m.start() != at:
            raise ValueError(f"no turn at {at}")
        at = m.end()
        turns.append(("assistant", unescape(m[1]), True) if m[1] is not None else (unescape(m[2]), unescape(m[3]), False))
    if at != len(formatted):
        raise ValueError(f"no turn at {at}")
    return turns


FORMATTED = (
    "conv_id long, turn long, formatted string, loss_start int, loss_end int, n_attachment_tokens long, "
    "attachments array<struct<kind:string,ref:string,n_tokens:long>>"
)


def format_turns(conversations: DataFrame, costs: TokenCosts = TokenCosts(), parts: bool = False) -> DataFrame:
    """Each turn's piece of its formatted conversation; the pieces joined by turn are the whole.

    With ``parts`` the text column holds a JSON list of parts where it parses as
    one, else it is plain text. Null text is empty, a null role is ``user``. Every
    row is formatted on its own, so no conversation is gathered; other columns
    than conv_id, turn, role and text are not read.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(n).to_pylist() for n in ("conv_id", "turn", "role", "text")]
            rows = []
            for conv, turn, role, text in zip(*columns, strict=True):
                content = _parts(text) if parts else text
                piece, start, end, found = render("user" if role is None else role, content, costs)
                rows.append((conv, turn, piece, start, end, sum(a[2] for a in found), [dict(zip(("kind", "ref", "n_tokens"), a, strict=True)) for a in found]))
            for at in range(0, len(rows), 1024):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*rows[at : at + 1024], strict=True), _TYPES, strict=True)],
                    names=["conv_id", "turn", "formatted", "loss_start", "loss_end", "n_attachment_tokens", "attachments"],
                )

    plain = conversations.select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return plain.mapInArrow(run, FORMATTED)


_TYPES = [
    pa.int64(), pa.int64(), pa.string(), pa.int32(), pa.int32(), pa.int64(),
    pa.list_(pa.struct([("kind", pa.string()), ("ref", pa.string()), ("n_tokens", pa.int64())])),
]


def _parts(text: str | None):
    if not text or text.lstrip()[:1] != "[":
        return text
    try:
        found = json.loads(text)
    except ValueError:
        return text
    return found if isinstance(found, list) and all(isinstance(p, dict) and "type" in p for p in found) else text


DIGESTS = "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long"


class _Digest:
    def __init__(self, conv):
        self.conv, self.n, self.loss_chars, self.chars = conv, 0, 0, 0
        self.turns, self.loss = hashlib.sha256(), hashlib.sha256()

    def add(self, piece: str, start: int, end: int) -> None:
        for role, text, _ in read_back(piece):
            self.n += 1
            self.turns.update(f"{role}\n{text}\n".encode("utf-8", "surrogatepass"))
        under = unescape(piece[start:end])
        self.loss.update(under.encode("utf-8", "surrogatepass"))
        self.loss_chars += len(under)
        self.chars += len(piece)

    def row(self) -> dict:
        return {
            "conv_id": self.conv, "n_turns": self.n, "turns_sha256": self.turns.hexdigest(), "loss_chars": self.loss_chars,
            "loss_sha256": self.loss.hexdigest(), "formatted_chars": self.chars,
        }


def conversation_digests(formatted: DataFrame) -> DataFrame:
    """Digests of whole conversations, read back from their formatted turns.

    Turns are sorted on disk by conversation and turn (equal turns by their
    formatted text) and streamed through one running hash per conversation, so a
    task holds one turn at a time whatever a conversation's length. Rows without a
    conversation id form one conversation of their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()), ("loss_sha256", pa.string()), ("formatted_chars", pa.int64())])
        now, done = None, []
        for batch in batches:
            for conv, piece, start, end in zip(*(batch.column(n).to_pylist() for n in ("conv_id", "formatted", "loss_start", "loss_end")), strict=True):
                if now is None or now.conv != conv:
                    done += [now.row()] if now else []
                    now = _Digest(conv)
                now.add(piece, start, end)
            if done:
                yield pa.RecordBatch.from_pylist(done, schema)
                done = []
        if now:
            yield pa.RecordBatch.from_pylist([now.row()], schema)

    pieces = formatted.select("conv_id", "turn", "formatted", "loss_start", "loss_end")
    dealt = pieces.repartition("conv_id").sortWithinPartitions("conv_id", "turn", "formatted")
    return dealt.mapInArrow(run, DIGESTS)
