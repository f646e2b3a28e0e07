import datetime as dt
from collections import Counter

import pytest

from tillsight.operators import cleaning, diagnostics, reports
from tillsight.sources import read_sales_csv


def test_csv_scan_reads_strings(dirty_raw):
    assert dirty_raw.columns == ["store_nbr", "family", "city", "date", "sales", "transactions", "onpromotion"]
    assert {f.dataType.simpleString() for f in dirty_raw.schema.fields} == {"string"}
    assert dirty_raw.count() == 15


def test_csv_missing_column_raises(spark, tmp_path):
    p = tmp_path / "bad.csv"
    p.write_text("store_nbr,family,date,sales\n1,A,01/01/2014,3\n")
    with pytest.raises(ValueError, match="city"):
        read_sales_csv(spark, str(p))


def test_drop_nulls(dirty_raw):
    assert cleaning.drop_nulls(dirty_raw).count() == 14


def test_typed_casts(dirty_raw):
    typed = cleaning.cast_sales(cleaning.drop_nulls(dirty_raw))
    rows = typed.collect()
    eggs = [r for r in rows if r.family == "EGGS"][0]
    assert eggs.transactions == 12
    dairy = [r for r in rows if r.family == "DAIRY" and r.city == "Quito"][0]
    assert dairy.date == dt.date(2014, 1, 5)
    nan_row = [r for r in rows if r.transactions == 5][0]
    assert nan_row.sales is None
    assert [r for r in rows if r.sales is not None and r.sales == 8 and r.date is None]


def test_clean_pipeline_keeps_eight(clean_sales):
    rows = clean_sales.collect()
    assert len(rows) == 8
    fams = sorted((r.store_nbr, r.family) for r in rows)
    assert fams.count(("1", "GROCERY")) == 1
    assert ("3", "CHEF'S CUT") in fams
    assert any(r.onpromotion is None for r in rows)
    assert any(r.date is None for r in rows)


def test_clean_is_idempotent(clean_sales):
    again = cleaning.keep_valid(cleaning.dedup(clean_sales))
    assert Counter(again.collect()) == Counter(clean_sales.collect())


def test_invalid_counts_before_and_after(dirty_raw, clean_sales):
    typed = cleaning.cast_sales(cleaning.drop_nulls(dirty_raw))
    r = diagnostics.invalid_counts(typed).first()
    assert (r.zero_sales_with_tx, r.sales_with_zero_tx) == (1, 1)
    r2 = diagnostics.invalid_counts(clean_sales).first()
    assert (r2.zero_sales_with_tx, r2.sales_with_zero_tx) == (0, 0)


def test_duplicate_groups(dirty_raw):
    typed = cleaning.cast_sales(cleaning.drop_nulls(dirty_raw))
    d = diagnostics.duplicate_groups(typed).collect()
    assert len(d) == 1 and d[0]["family"] == "GROCERY" and d[0]["count"] == 2


def test_promotion_buckets(clean_sales):
    got = {r.promotion_range: r for r in reports.promotion_impact(clean_sales).collect()}
    assert set(got) == set(reports.PROMOTION_LABELS)
    total = sum(r.total_sales for r in got.values())
    assert total == pytest.approx(sum(r.sales for r in clean_sales.collect()))
    # 50.5 and the null promotion fall in the last bucket
    assert got["High Promotion (>50)"].total_sales == pytest.approx(15.0)
    assert got["Medium Promotion (11-50)"].total_sales == pytest.approx(5.0)
    assert got["No Promotion"].total_sales == pytest.approx(100.5)


def test_null_date_excluded_from_growth_kept_in_totals(clean_sales):
    growth = reports.city_growth(clean_sales).collect()
    assert all(r.year is not None for r in growth)
    totals = {r.city: r.total_sales for r in reports.city_totals(clean_sales).collect()}
    assert totals["Loja"] == pytest.approx(7 + 8 + 8 + 8)


def test_apostrophes_survive_city_filter(clean_sales):
    rows = reports.city_growth_for(clean_sales, "Santa D'Or").collect()
    assert [(r.city, r.year) for r in rows] == [("Santa D'Or", 2015)]


def test_default_city_choice_is_first_by_name(clean_sales):
    rows = reports.city_growth_for(clean_sales, choices=10).collect()
    assert {r.city for r in rows} == {"Loja"}


def test_values_that_are_not_finite_are_malformed(spark):
    raw = spark.createDataFrame(
        [("1", "A", "Q", "01/05/2014", v, "1", "0") for v in ("Infinity", "-Infinity", "inf", "1e400", "NaN", "5")],
        "store_nbr string, family string, city string, date string, sales string, transactions string, onpromotion string")
    from tillsight.operators import timeseries
    clean = cleaning.clean(raw)
    assert [r.sales for r in clean.collect()] == [5.0]
    assert [r.total_sales for r in timeseries.monthly_sales(cleaning.cast_sales(raw)).collect()] == [5.0]


def test_parts_with_another_header_order_raise(spark, tmp_path):
    head = "store_nbr,family,city,date,sales,transactions,onpromotion"
    swapped = "family,store_nbr,city,date,transactions,sales,onpromotion"
    (tmp_path / "a.csv").write_text(f"{head}\n1,A,Q,1/1/2014,5,2,0\n")
    (tmp_path / "b.csv").write_text(f"{swapped}\nB,2,Q,1/1/2014,3,7,0\n")
    from tillsight.sources import read_sales_csv
    with pytest.raises(Exception, match="(?s)header does not conform|FAILED_READ_FILE"):
        read_sales_csv(spark, str(tmp_path)).collect()


def test_parts_with_different_headers_are_read_by_name(spark, tmp_path):
    from tillsight.sources import read_sales_parts
    folder = tmp_path / "parts"
    folder.mkdir()
    (folder / "a.csv").write_text("store_nbr,family,city,date,sales,transactions,onpromotion\n1,A,Q,1/1/2014,5,2,0\n1,B,Q\n")
    (folder / "b.csv").write_text('sales,"family",city,date,store_nbr,transactions,onpromotion,note\n7,C,"L, x",1/2/2014,2,3,1,hi\n8,C,L,1/2/2014,2,3,1,hi,more\n')
    (folder / "c.csv").write_text("store_nbr,family,city,date,sales,transactions,onpromotion\n3,D,R,1/3/2014,9,1,0\n")
    (folder / "empty.csv").write_text("")
    rows, lines = read_sales_parts(spark, str(folder))
    assert rows.columns == ["store_nbr", "family", "city", "date", "sales", "transactions", "onpromotion", "note"]
    assert rows.select("city").count() == rows.count() == 3 and lines.count() == 2      # also of pruned scans
    assert sorted(map(tuple, rows.collect()), key=str) == sorted([
        ("1", "A", "Q", "1/1/2014", "5", "2", "0", None), ("2", "C", "L, x", "1/2/2014", "7", "3", "1", "hi"),
        ("3", "D", "R", "1/3/2014", "9", "1", "0", None)], key=str)
    assert sorted((r.file.rsplit("/", 1)[1], r.line) for r in lines.collect()) == [
        ("a.csv", "1,B,Q"), ("b.csv", "8,C,L,1/2/2014,2,3,1,hi,more")]
    (folder / "d.csv").write_text("store_nbr,family\n1,A\n")
    with pytest.raises(ValueError, match="lacks columns"):
        read_sales_parts(spark, str(folder))
    with pytest.raises(FileNotFoundError):
        read_sales_parts(spark, str(tmp_path / "nothing"))
