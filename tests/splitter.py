"""The splitter as a plain program, to hold the library's columns against."""

from __future__ import annotations


def split_text(text: str, size: int, overlap: int, separators: tuple[str, ...]) -> list[str]:
    """Pieces of at most ``size`` characters, cut at the coarsest separator that does, each
    starting with up to ``overlap`` characters of whole units of the one before."""
    for depth, mark in enumerate(separators):
        if mark in text:
            break
    else:
        return [text[i : i + size].strip() for i in range(0, len(text), size) if text[i : i + size].strip()]
    head, *tail = text.split(mark)
    units = [u for u in (head, *(mark + t for t in tail)) if u]
    pieces: list[str] = []
    window: list[str] = []
    held = 0

    def emit() -> None:
        if piece := "".join(window).strip():
            pieces.append(piece)

    for unit in units:
        if len(unit) >= size:
            emit()
            window.clear()
            held = 0
            pieces += split_text(unit, size, overlap, separators[depth + 1 :])
            continue
        if held + len(unit) > size:
            emit()
            while window and (held > overlap or held + len(unit) > size):
                held -= len(window.pop(0))
        window.append(unit)
        held += len(unit)
    emit()
    return pieces
