"""op2: unfinished tags in linear time, cells over several rows and columns, closed details."""

from __future__ import annotations

import random
import re
import time

import pytest

from catalens.llm.html_text import TagEnds, visible_text


@pytest.mark.parametrize("unit", ["<a ", '<a "', "<!", "<a<a", "<a '\"", "</", "<td colspan=1000 rowspan=9>"])
def test_unfinished_tags_take_linear_time(unit):
    start = time.process_time()
    visible_text(unit * 50_000)
    assert time.process_time() - start < 6  # seconds; a rescan from every tag takes minutes


def test_tag_ends_against_a_scan_from_every_place():
    rng = random.Random(3)
    for _ in range(200):
        page = "".join(rng.choice("<a>\"' ") for _ in range(rng.randint(0, 30)))
        ends = TagEnds(page)
        for at in range(len(page) + 1):
            quote, want = "", -1
            for i in range(at, len(page)):
                if quote:
                    quote = "" if page[i] == quote else quote
                elif page[i] in "\"'":
                    quote = page[i]
                elif page[i] == ">":
                    want = i
                    break
            assert ends.after(at) == want


def slow_table(rows: list[list[tuple[str, int, int]]]) -> list[str]:
    """Cells put on a grid of single places, then every line built place by place."""
    grid: dict[tuple[int, int], tuple] = {}
    for r, row in enumerate(rows):
        c = 0
        for cell in row:
            while (r, c) in grid:
                c += 1
            for i in range(r, min(r + cell[2], len(rows))):
                for j in range(c, c + cell[1]):
                    grid[i, j] = (cell[0], r, c, cell[1])
            c += cell[1]
    starts = sorted({c for _, _, c, _ in grid.values()})
    width = dict.fromkeys(starts, 0)
    cells = sorted(set(grid.values()), key=lambda x: (sum(x[2] <= s < x[2] + x[3] for s in starts), starts.index(x[2])))
    for text, _, c, n in cells:
        inside = [s for s in starts if c <= s < c + n]
        width[inside[-1]] += max(0, len(text) - sum(width[s] for s in inside) - 2 * (len(inside) - 1))
    out = []
    for r in range(len(rows)):
        line = [" "] * (sum(width.values()) + 2 * len(starts) + 100)
        for text, row, c, _ in set(grid.values()):
            if row == r:
                at = sum(width[s] + 2 for s in starts if s < c)
                line[at : at + len(text)] = text
        out.append("".join(line).rstrip())
    return out


def test_spans_against_a_slow_grid():
    rng = random.Random(8)
    for _ in range(300):
        rows = []
        for _ in range(rng.randint(1, 5)):
            cells = rng.randint(1, 4)
            # overlapping cells are not compared: only the first cell of a row may span rows
            rows.append([("x" * rng.randint(1, 9), rng.randint(1, 3), rng.randint(1, 3) if i == 0 else 1) for i in range(cells)])
        taken: list[int] = []
        for r, row in enumerate(rows):  # a wide cell must not reach into a held column
            if any(r < x for x in taken):
                row[:] = [(t, 1, 1) for t, _, _ in row]
            taken.append(r + row[0][2])
        page = "<table>" + "".join(
            "<tr>" + "".join(f"<td colspan={a} rowspan={d}>{t}</td>" for t, a, d in row) + "</tr>" for row in rows
        ) + "</table>"
        assert visible_text(page).split("\n") == [x for x in slow_table(rows) if x]


def test_spans_end_with_their_row_group():
    page = "<table><tbody><tr><td rowspan=5>A<td>B<tr><td>C<tbody><tr><td>D<td>E</table>"
    assert visible_text(page) == "A  B\n   C\nD  E"
    assert visible_text("<table><tr><td rowspan=0>A<td>B<tr><td>C<tr><td>D</table>") == "A  B\n   C\n   D"
    assert visible_text("<table><tr><td colspan=x>A<td colspan=-1>B</table>") == "A  B"


def test_details_show_what_is_open():
    assert visible_text("<details><summary>S</summary>hidden</details>") == "S"
    assert re.split(r"\n+", visible_text("<details open><summary>S</summary>seen</details>")) == ["S", "seen"]
    assert visible_text("<details>hidden</details>") == ""


def test_broken_markup_is_text():
    assert visible_text("<p>1 < 2 & 3 </> x <?php echo ?> y <!doctype z> <a href='a>b'>L</a> <b") == "1 < 2 & 3 x y L <b"
    assert visible_text("<!-- open comment <p>x") == ""
