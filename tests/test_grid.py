"""Grids whose lines are known."""

import pytest

from gridscribe.operators.grid import Cell, Grid, Item, Line, cell_items, flatten_grid, fuse_slices, header_rows, logical_rows, structure_of


def cell(r, c, text, rs=1, cs=1, width=100.0, items=None, full=False):
    box = (c * width, r * 20.0, (c + cs) * width, (r + rs) * 20.0)
    rows = tuple(Line(t, box[0] + 2, box[2] - 1 if full else box[0] + 40, box[1] + 12 * k, box[1] + 12 * k + 10) for k, t in enumerate(text.split("\n"))) if text else ()
    return Cell(r, c, rs, cs, box, rows, items)


def table(*rows):
    return Grid(len(rows), len(rows[0]), [cell(r, c, t) for r, row in enumerate(rows) for c, t in enumerate(row)])


def lines(grid, **k):
    return flatten_grid(grid, **k)[0]


def test_header_and_row():
    out, headers, _ = flatten_grid(table(["Tên", "Tuổi", "Chức vụ"], ["Nam", "25", "Dev"]))
    assert out == ["- Tên: Nam  |  Tuổi: 25  |  Chức vụ: Dev"] and headers == ["Tên", "Tuổi", "Chức vụ"]


def test_made_up_headers_are_not_said():
    assert lines(table(["Cột 1", "Cột 2"], ["Nam", "25"])) == ["- Nam  |  25"]


def test_continuation():
    before = ["Mã HĐ", "Ngày Xuất"]
    page = table(["HD-1", "01/02"], ["HD-2", "03/02"])
    assert lines(page, before=before) == ["- Mã HĐ: HD-1  |  Ngày Xuất: 01/02", "- Mã HĐ: HD-2  |  Ngày Xuất: 03/02"]
    assert lines(table(["Mã HĐ", "Ngày Xuất"], ["HD-9", "05/02"]), before=before) == ["- Mã HĐ: HD-9  |  Ngày Xuất: 05/02"]


def test_rule_of_one_column_is_no_row():
    cells = [cell(0, c, t) for c, t in enumerate(("A", "B", "C"))] + [cell(1, 0, "x", rs=2), cell(1, 1, "one"), cell(2, 1, "two"), cell(1, 2, "z", rs=2)]
    assert lines(Grid(3, 3, cells)) == ["- A: x  |  B: one two  |  C: z"]


def test_two_dimensional():
    cells = [cell(0, 0, "Điều kiện"), cell(0, 1, "a long sentence over both columns", cs=2), cell(1, 0, "Tình huống"), cell(1, 1, "Thỏa điều kiện đó"), cell(1, 2, "Không thỏa điều kiện đó"), cell(2, 0, "Thứ tự"), cell(2, 1, "Đóng cho bên A trước"), cell(2, 2, "Đóng cho bên B trước")]
    grid = Grid(3, 3, cells)
    assert structure_of(grid) == (0, True)
    assert lines(grid) == [
        "- Điều kiện: a long sentence over both columns  |  Tình huống: Thỏa điều kiện đó  |  Thứ tự: Đóng cho bên A trước",
        "- Điều kiện: a long sentence over both columns  |  Tình huống: Không thỏa điều kiện đó  |  Thứ tự: Đóng cho bên B trước",
    ]


def test_spanning_value_is_repeated():
    cells = [cell(0, c, t) for c, t in enumerate(("Mục", "Phí", "Ghi chú"))] + [cell(r, c, f"{'ab'[c]}{r}") for r in (1, 2, 3) for c in (0, 1)] + [cell(1, 2, "chung", rs=3)]
    assert lines(Grid(4, 3, cells)) == [f"- Mục: a{r}  |  Phí: b{r}  |  Ghi chú: chung" for r in (1, 2, 3)]


def test_sliced_paragraph_is_fused():
    cells = [cell(0, 0, "K"), cell(0, 1, "Nội dung"), cell(1, 0, "x", rs=3)] + [cell(r, 1, f"part {r}", full=True) for r in (1, 2, 3)]
    grid = fuse_slices(Grid(4, 2, cells))
    assert [c.row_span for c in grid.cells if c.col == 1] == [1, 3]
    assert lines(Grid(4, 2, cells)) == ["- K: x  |  Nội dung: part 1 part 2 part 3"]


def test_two_header_rows():
    cells = [cell(0, 0, "", rs=2), cell(0, 1, "Tuổi của Người được"), cell(1, 1, "bảo hiểm chính (tuổi)"), cell(2, 0, "0", cs=2)]
    grid = Grid(3, 2, cells)
    assert header_rows(grid) == 2
    assert lines(grid) == ["- Tuổi của Người được bảo hiểm chính (tuổi): 0"]


def test_rows_that_number_themselves_have_no_dash():
    assert lines(table(["Mục", "Tên"], ["6.1", "Mục đích"], ["6.2", "Phạm vi"])) == ["- Mục: 6.1  |  Tên: Mục đích", "- Mục: 6.2  |  Tên: Phạm vi"]
    assert lines(table(["STT", "Hồ sơ"], ["1", "Đơn"], ["2", "Sao kê"])) == ["1  |  Hồ sơ: Đơn", "2  |  Hồ sơ: Sao kê"]


def test_cell_of_several_items():
    cells = [cell(0, 0, "Khoản"), cell(0, 1, "Nội dung chi tiết"), cell(1, 0, "3.1"), cell(1, 1, "- one\n- two")]
    assert lines(Grid(2, 2, cells)) == ["- Khoản: 3.1  |  Nội dung chi tiết:", "  - one", "  - two"]


def test_items_of_a_format_that_states_them():
    known = (Item(0, "a", ""), Item(1, "b", "o"))
    assert cell_items(cell(0, 0, "x", items=known)) == list(known)
    assert cell_items(cell(0, 0, "", items=())) == []
    out = lines(Grid(2, 2, [cell(0, 0, "K"), cell(0, 1, "V"), cell(1, 0, "x"), cell(1, 1, "a\nb", items=known)]))
    assert out == ["- K: x  |  V:", "  - a", "    + b"]


def test_wrapped_lines_and_buried_items():
    c = cell(0, 0, "Khoả\nn vay: a) Sao kê\nb) Hồ sơ")
    assert [x.text for x in cell_items(c)] == ["Khoản vay:", "a) Sao kê", "b) Hồ sơ"]


def test_blank_rows_leave_nothing():
    out = lines(table(["A", "B"], ["1a", "2b"], ["", ""], ["3c", "4d"]))
    assert out and all(x.strip() for x in out)


def test_carried_over_cell_is_no_header():
    grid = table(["", "", "tiếp"], ["3.8", "Vay", "Hàng năm"], ["3.9", "Trả nợ", "Hàng tháng"])
    assert header_rows(grid) == 0
    assert lines(grid)[-1] == "3.9  |  Trả nợ  |  Hàng tháng"


def test_header_alone():
    assert lines(Grid(2, 2, [cell(0, 0, "A"), cell(0, 1, "B")])) == ["- A  |  B"]


@pytest.mark.parametrize("grid", [table(["A", "B"], ["x", "y"]), table(["Alpha"], ["beta"]), table(["-1", "2"], ["3", "4"])])
def test_no_word_is_lost(grid):
    from gridscribe.functions.lines import tokens

    have = tokens("\n".join(lines(grid)))
    assert all(t in have for c in grid.cells for t in tokens(c.text))


def test_logical_rows_of_a_rowspan_group():
    cells = [cell(0, 0, "Nhóm A", rs=3)] + [cell(r, 1, f"{'I' * (r + 1)}") for r in range(3)]
    assert [[c.text for c in row] for row in logical_rows(Grid(3, 2, cells), 0)] == [["Nhóm A", "I"], ["Nhóm A", "II"], ["Nhóm A", "III"]]
