"""Small per-snippet helpers around the standard ``ast`` module, used inside Arrow-batched workers."""

from __future__ import annotations

import ast
import warnings
from collections.abc import Callable

# Markers of the linearised form.
LIST_END = "</l>"
STRING_IN_LIST = "<strtoken>"
STRING_FIELD = "<t>"
LITERAL, STRING = "#literal", "#strliteral"
START, END = "<s>", "</s>"
ROOT_FIELD, END_FIELD = "root", "end"


def parse(text: str) -> ast.Module | None:
    try:
        with warnings.catch_warnings():
            warnings.simplefilter("ignore")
            return ast.parse(text)
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None


def reprint(text: str, keep: bool) -> str | None:
    """Canonical print of the code; on a syntax error the text itself if ``keep``, else None."""
    tree = parse(text)
    try:
        return ast.unparse(tree) if tree is not None else (text if keep else None)
    except RecursionError:
        return text if keep else None


class Walk:
    """Pre-order events ``(label, kind, path, children, field)`` of one snippet.

    Kinds ``node``, ``special``, ``literal`` and ``strliteral`` are tokens; ``list`` and ``singleton`` are
    fields. ``path`` runs from the element up to the root in 1-based ordinals; ``children`` counts the
    fields of a node, or the elements of a field with its list end; ``field`` is the field a token stands
    in. Load/store contexts are left out. With ``pieces``, a function that cuts text, string literals
    become one element per piece.
    """

    def __init__(self, pieces: Callable[[str], list[str]] | None = None):
        self.pieces = pieces

    def sentence(self, tree: ast.Module) -> list[tuple]:
        """The whole snippet between its start and end marker."""
        events: list[tuple] = [(START, "special", [1], 2, "")]
        self.field(f"{START}_{ROOT_FIELD}", tree, [1, 1], events.append)
        events.append((f"{START}_{END_FIELD}", "singleton", [2, 1], 1, None))
        events.append((END, "special", [1, 2, 1], 0, f"{START}_{END_FIELD}"))
        return events

    def same_after_reprint(self, tree: ast.Module, events: list[tuple] | None = None) -> bool:
        """Whether printing and parsing again gives the same sentence; ``events`` are those of the tree where they are known."""
        try:
            again = parse(ast.unparse(tree))
            return again is not None and self.sentence(again) == (events or self.sentence(tree))
        except RecursionError:
            return False

    def node(self, value: ast.AST, path: list[int], inside: str, add: Callable[[tuple], None]) -> None:
        name = type(value).__name__
        fields = [(f, v) for f, v in ast.iter_fields(value) if not isinstance(v, ast.expr_context)]
        add((name, "node", path, len(fields), inside))
        for place, (field, content) in enumerate(fields, 1):
            self.field(f"{name}_{field}", content, [place, *path], add)

    def field(self, label: str, content, path: list[int], add: Callable[[tuple], None]) -> None:
        """One field and everything in it."""
        if isinstance(content, (str, bytes)):
            texts = self.text(content)
            add((label, "list", path, len(texts) + 1, None))
            for place, text in enumerate(texts, 1):
                add((text + STRING, "strliteral", [place, *path], 0, label))
            add((LIST_END, "special", [len(texts) + 1, *path], 0, label))
        elif isinstance(content, list):
            add((label, "list", path, len(content) + 1, None))
            for place, item in enumerate(content, 1):
                self.item(item, [place, *path], label, add)
            add((LIST_END, "special", [len(content) + 1, *path], 0, label))
        else:
            add((label, "singleton", path, 1, None))
            self.item(content, [1, *path], label, add)

    def item(self, value, path: list[int], inside: str, add: Callable[[tuple], None]) -> None:
        """One value of a field: a node, a wrapped string, or another literal."""
        if isinstance(value, ast.AST):
            self.node(value, path, inside, add)
        elif isinstance(value, (str, bytes)):
            add((STRING_IN_LIST, "node", path, 1, inside))
            self.field(f"{STRING_IN_LIST}_{STRING_FIELD}", value, [1, *path], add)
        else:
            add((ascii(value) + LITERAL, "literal", path, 0, inside))

    def text(self, value: str | bytes) -> list[str]:
        if self.pieces is None:
            return [ascii(value)]
        plain = value.decode("latin-1") if isinstance(value, bytes) else value
        return self.pieces(plain) or [""]
