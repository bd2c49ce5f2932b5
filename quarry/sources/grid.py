"""A table of sparse cells and its Markdown."""

from __future__ import annotations

from collections import defaultdict


class Grid:
    """Texts by (row, column); the declared size is a lower bound of what is shown."""

    def __init__(self, rows: int = 0, cols: int = 0):
        self.rows, self.cols = rows, cols
        self.texts: defaultdict[tuple[int, int], list[str]] = defaultdict(list)

    def put(self, row: int, col: int, text: str) -> None:
        """Add text to a cell after what it has."""
        self.rows, self.cols = max(self.rows, row + 1), max(self.cols, col + 1)
        self.texts[row, col].append(text)

    def cell(self, row: int, col: int) -> str:
        """A cell on one line, its bars escaped."""
        words = " ".join(self.texts.get((row, col), ())).split()
        return " ".join(words).replace("|", "\\|")

    def markdown(self) -> str:
        """A header line, a rule and the other lines; empty without any text."""
        show = [[self.cell(r, c) for c in range(self.cols)] for r in range(self.rows)]
        if not any(text for line in show for text in line):
            return ""
        show[1:1] = [["---"] * self.cols]
        return "\n".join(f"| {' | '.join(line)} |" for line in show)
