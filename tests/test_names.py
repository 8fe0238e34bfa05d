import pytest

from tallymark.functions import names as N


@pytest.mark.parametrize("raw, want", [
    (" Total ($) ", "Total"), ("a--b  c", "a_b_c"), ("1st", "col_1st"), ("***", "unnamed_column"),
    ("", "unnamed_column"), ("été", "été")])
def test_csv_names(raw, want):
    assert N.csv_name(raw) == want


@pytest.mark.parametrize("raw, want", [
    ("Key No.", "key_no_"), (None, "column"), ("  ", "column"), ("nan", "column"),
    ("Amt (USD)/Unit", "amt_usd_unit"), ("A\\B-c", "a_b_c")])
def test_sheet_column_names(raw, want):
    assert N.sheet_column_name(raw) == want


def test_duplicates_are_numbered_without_clashes():
    assert N.number_duplicates(["a", "a", "b", "a"]) == ["a", "a_1", "b", "a_2"]
    assert N.number_duplicates(["a", "a", "a_1"]) == ["a", "a_2", "a_1"]
    assert N.number_duplicates(["Name", "name"]) == ["Name", "name_1"]


@pytest.mark.parametrize("stem, want", [
    ("uuid_sales", "sales"), ("orders", "orders"), ("x_2024-q1.final", "t_2024_q1_final"),
    ("a_b_c", "b_c"), ("x__y", "_y")])
def test_view_names(stem, want):
    assert N.view_name(stem) == want


def test_sheet_table_names():
    assert N.sheet_table_name("My Sheet/A\\B") == "my_sheet_a_b"
