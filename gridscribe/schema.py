"""Relations of the engine, as DDL."""

LINE = "struct<text: string, x0: double, x1: double, top: double, bottom: double>"
ITEM = "struct<level: int, text: string, marker: string>"
WORDS = "doc_id string, page int, word_id int, text string, x0 double, x1 double, top double, bottom double, size double"
RULINGS = "doc_id string, page int, x0 double, top double, x1 double, bottom double"
PAGES = "doc_id string, page int, width double, height double, rotation int"
CELLS = f"doc_id string, table_id string, row int, col int, row_span int, col_span int, x0 double, top double, x1 double, bottom double, lines array<{LINE}>, items array<{ITEM}>"
TABLES = "doc_id string, page int, table_id string, x0 double, top double, x1 double, bottom double"
PARAGRAPHS = "doc_id string, story string, seq int, text string, style_id string, num_id string, ilvl int, outline_lvl int, in_table boolean, table_seq int"
SHEET_CELLS = "doc_id string, sheet_idx int, sheet string, row int, col int, value_num double, value_ts timestamp, value_str string, value_bool boolean, number_format string"
MERGES = "doc_id string, sheet_idx int, min_row int, min_col int, max_row int, max_col int"
FLAT = "doc_id string, table_id string, lines array<string>, headers array<string>, header_rows int, label_column boolean, n_rows int, n_cols int"
NUMBERED = "doc_id string, table_id string, seq int, line string"
