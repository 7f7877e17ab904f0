"""The texts of raw records, by source: read when they are asked for, never kept with events."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import variants as V


def _said(text: Column) -> Column:
    return F.when(F.trim(text) != "", text)


def planted(record: Column) -> Column:
    return _said(V.text_at(record, "$.text"))


def support(record: Column) -> Column:
    """An action's text may hold personal values, and is never read."""
    return F.when(F.coalesce(V.text_at(record, "$.speaker") != "action", F.lit(True)), _said(V.text_at(record, "$.text")))


def transcript(record: Column) -> Column:
    """A record's message if it is a text; a text block; a tool's result, as a text or the texts of its blocks."""
    message = V.at(record, "$.message", "variant")
    kind = V.text_at(record, "$.type")
    blocks = V.at(record, "$.content", "variant")
    blocks = F.when(V.kind_of(blocks).startswith("ARRAY"), blocks.try_cast("array<variant>"))
    parts = F.filter(F.transform(blocks, lambda b: F.when(V.text_at(b, "$.type") == "text", _said(V.text_at(b, "$.text")))), lambda x: x.isNotNull())
    result = F.coalesce(_said(V.text_at(record, "$.content")), F.nullif(F.array_join(parts, "\n"), F.lit("")))
    is_record = F.coalesce(V.kind_of(message).startswith("OBJECT"), F.lit(False))
    return F.when(is_record, _said(V.text_at(record, "$.message.content"))).when(kind == "text", _said(V.text_at(record, "$.text"))).when(kind == "tool_result", result)


def silent(record: Column) -> Column:
    """Of sources without utterances."""
    return F.lit(None).cast("string")


TEXTS: dict[str, Callable[[Column], Column]] = {"abcd": support, "cc": transcript, "synthetic": planted}


def register_texts(name: str, texts: Callable[[Column], Column]) -> None:
    TEXTS[name] = texts


def texts_for(name: str) -> Callable[[Column], Column]:
    return TEXTS.get(name, silent)


def annotatable() -> list[str]:
    return sorted(TEXTS)


def slot_text(slots: Column, name: str) -> Column:
    """A slot's value as a text that can be asked about."""
    return _said(slots[name]["v"])


def at_pointer(document: Column, pointer: str) -> Column:
    """The part of a document that a raw pointer (/a/0/b) names."""
    steps = [s for s in pointer.split("/")[1:] if s]
    return V.at(document, "$" + "".join(f"[{s}]" if s.isdigit() else f"['{s}']" for s in steps), "variant")
