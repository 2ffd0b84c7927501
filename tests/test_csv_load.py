"""Loading CSV: quoting, line ends, headers, and lines that do not fit."""

from __future__ import annotations

import datetime
import random
from decimal import Decimal

import pytest

from ledgerlens.plans.audits import orphan_audit
from ledgerlens.session import new_table_path, write_table
from ledgerlens.sources import csv_load
from ledgerlens.sources.csv_load import load_csv_table, load_star
from ledgerlens.sources.schema import SCHEMAS
from ledgerlens.sources.star import Star

HEADER = ",".join(SCHEMAS["fact_transactions"].names)


def line(key, amount="12.50", channel="Web", moment="2024-01-02 03:04:05"):
    return f'{key},T{key},1,2,3,4,20240102,{amount},1,0,"{channel}",Purchase,Completed,3,2024-01-02,{moment}'


def load(spark, tmp_path, lines, line_end="\r\n", **options):
    source = tmp_path / "in.csv"
    source.write_bytes((line_end.join(lines) + line_end).encode())
    return load_csv_table(
        spark, "fact_transactions", str(source), new_table_path(spark, "loaded"), line_end=line_end, **options
    )


def test_good_lines_are_typed(spark, tmp_path):
    got = load(spark, tmp_path, [HEADER, line(1, channel="Web, mobile"), line(2, amount="3")])
    assert got.rejected.count() == 0
    assert got.accepted.schema.names == SCHEMAS["fact_transactions"].names
    rows = got.accepted.orderBy("transaction_key").collect()
    assert rows[0]["channel"] == "Web, mobile"
    assert rows[0]["transaction_datetime"] == datetime.datetime(2024, 1, 2, 3, 4, 5)
    assert [r["amount_usd"] for r in rows] == [Decimal("12.50"), Decimal("3.00")]


def test_bad_lines_are_kept_apart_as_read(spark, tmp_path):
    short, long = "3,T3,1", line(4) + ",surplus"
    lines = [HEADER, line(1), short, long, line(5, amount="a lot"), line(6, moment="yesterday"), line(7)]
    got = load(spark, tmp_path, lines)
    assert sorted(r["transaction_key"] for r in got.accepted.collect()) == [1, 7]
    assert {r[0] for r in got.rejected.collect()} == {short, long, lines[4], lines[5]}
    assert got.counts().first().asDict() == {"accepted_rows": 2, "rejected_rows": 4}


def test_null_marker_and_empty_fields(spark, tmp_path):
    got = load(spark, tmp_path, [HEADER, line(1, amount="\\N"), line(2, channel=""), line(3, amount="")])
    rows = {r["transaction_key"]: r for r in got.accepted.collect()}
    assert rows[1]["amount_usd"] is None and rows[2]["channel"] == "" and rows[3]["amount_usd"] is None
    assert got.rejected.count() == 0


def test_every_table_can_be_loaded(spark, tmp_path):
    values = {"int": "1", "bigint": "2", "string": "x", "date": "2024-01-02", "timestamp_ntz": "2024-01-02 00:00:00"}
    for name, schema in SCHEMAS.items():
        source = tmp_path / f"{name}.csv"
        fields = [values.get(f.dataType.simpleString(), "1.25") for f in schema]
        source.write_text(",".join(schema.names) + "\r\n" + ",".join(fields) + "\r\n", newline="")
        got = load_csv_table(spark, name, str(source), new_table_path(spark, name))
        assert got.counts().first().asDict() == {"accepted_rows": 1, "rejected_rows": 0}


def test_all_lines_bad_or_none(spark, tmp_path):
    assert load(spark, tmp_path, [HEADER, "x"]).counts().first().asDict() == {"accepted_rows": 0, "rejected_rows": 1}
    assert load(spark, tmp_path, [HEADER]).counts().first().asDict() == {"accepted_rows": 0, "rejected_rows": 0}


def test_line_feed_alone(spark, tmp_path):
    assert load(spark, tmp_path, [HEADER, line(1), line(2)], line_end="\n").accepted.count() == 2


def test_loading_again_replaces_the_table(spark, tmp_path):
    target = new_table_path(spark, "loaded")
    for keys in ([1, 2, 3], [4]):
        source = tmp_path / f"in{len(keys)}.csv"
        source.write_text("\r\n".join([HEADER, *map(line, keys)]) + "\r\n", newline="")
        got = load_csv_table(spark, "fact_transactions", str(source), target)
    assert [r["transaction_key"] for r in got.accepted.collect()] == [4]


def test_a_reload_without_bad_lines_leaves_none(spark, tmp_path):
    target = new_table_path(spark, "loaded")
    spark.conf.set("spark.sql.sources.partitionOverwriteMode", "dynamic")
    try:
        for lines in ([line(1), "x", "y"], [line(2)], []):
            source = tmp_path / f"in{len(lines)}.csv"
            source.write_text("\r\n".join([HEADER, *lines]) + "\r\n", newline="")
            got = load_csv_table(spark, "fact_transactions", str(source), target)
            good = sum("," in text for text in lines)
            assert got.counts().first().asDict() == {"accepted_rows": good, "rejected_rows": len(lines) - good}
    finally:
        spark.conf.unset("spark.sql.sources.partitionOverwriteMode")


def test_quotes_inside_a_field(spark, tmp_path):
    written = {
        1: '"A ""B"" C"', 2: '"x"",y"', 3: r'"A \"B\" C"', 4: r'"x\",y"', 5: r'"back\\"', 6: r'"a\\""b"', 7: '""""', 8: "' plain \\ '", 9: '"  trimmed "'
    }
    meant = {1: 'A "B" C', 2: 'x",y', 3: 'A "B" C', 4: 'x",y', 5: "back\\", 6: 'a\\"b', 7: '"', 8: "' plain \\ '", 9: "trimmed"}
    lines = [line(key).replace('"Web"', field) for key, field in written.items()]
    got = load(spark, tmp_path, [HEADER, *lines])
    assert {r["transaction_key"]: r["channel"] for r in got.accepted.collect()} == meant
    assert got.rejected.count() == 0


def test_a_star_opens_the_folder_that_was_loaded(spark, tmp_path):
    (tmp_path / "in.csv").write_text("\r\n".join([HEADER, line(1), "bad", line(2)]) + "\r\n", newline="")
    got = load_csv_table(spark, "fact_transactions", str(tmp_path / "in.csv"), str(tmp_path / "star" / "fact_transactions"))
    fact = Star.from_parquet(spark, str(tmp_path / "star")).fact
    assert fact.columns == SCHEMAS["fact_transactions"].names
    assert sorted(r["transaction_key"] for r in fact.collect()) == [1, 2]
    assert [r[0] for r in got.rejected.collect()] == ["bad"]


def test_a_whole_star_is_loaded_and_audited(spark, tmp_path):
    values = {"int": "1", "bigint": "2", "string": "x", "date": "2024-01-02", "timestamp_ntz": "2024-01-02 00:00:00"}
    for name, schema in SCHEMAS.items():
        fields = [values.get(f.dataType.simpleString(), "1.25") for f in schema]
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / name).write_text(",".join(schema.names) + "\r\n" + ",".join(fields) + "\r\n", newline="")
    star, loads = load_star(spark, str(tmp_path / "in"), str(tmp_path / "star"))
    assert all(load.rejected.count() == 0 for load in loads.values())
    assert {r["dimension"]: r["unknown_key_rows"] for r in orphan_audit(star).collect()} == dict.fromkeys(
        (name for name in SCHEMAS if name.startswith("dim_")), 0
    )


def raw(frame) -> list[bytes]:
    return sorted(bytes(row[0]) for row in frame.selectExpr("cast(bad_line as binary)").collect())


def test_odd_signs_stay(spark, tmp_path):
    odd = ["a\x01b", "tab\there", "nul\x00", "\x7f\x1f", "\ufeffmark", "lone \r and \n", "\u2028", "a\\b"]
    lines = [line(i, channel=text.replace("\\", "\\\\")) for i, text in enumerate(odd)]
    got = load(spark, tmp_path, [HEADER, *lines])
    assert {r["transaction_key"]: r["channel"] for r in got.accepted.collect()} == dict(enumerate(odd))
    assert got.rejected.count() == 0


def test_rejected_records_are_kept_byte_for_byte(spark, tmp_path):
    bad = [b"1,a\x01b", b"\xff\xfe,2", b"3\x00", b'4,"x ""y"" \\" z",5', b"  5 , ", b'6,"two\r\nlines",7']
    source = tmp_path / "in.csv"
    source.write_bytes(b"\r\n".join([HEADER.encode(), *bad, line(1).encode()]) + b"\r\n")
    got = load_csv_table(spark, "fact_transactions", str(source), new_table_path(spark, "loaded"))
    assert raw(got.rejected) == sorted(bad)
    assert [r["transaction_key"] for r in got.accepted.collect()] == [1]


def test_line_ends_inside_quotes(spark, tmp_path):
    texts = ["one\r\ntwo", "\r\n\r\n", 'say ""x""\r\n"",', "a,b\r\n1,2,3", "ends\r\n\\", "plain", "\r\n"]
    lines = [line(i, channel=text.replace("\\", "\\\\")) for i, text in enumerate(texts)]
    meant = {i: text.replace('""', '"').strip(" ") for i, text in enumerate(texts)}
    got = load(spark, tmp_path, [HEADER, *lines])
    assert {r["transaction_key"]: r["channel"] for r in got.accepted.collect()} == meant
    assert got.rejected.count() == 0


@pytest.mark.parametrize("seed", range(3))
def test_records_over_many_splits(spark, tmp_path, seed):
    """Files that are cut at any place give the same records as a reader that goes through them."""
    draw = random.Random(seed)
    pieces = ["x", "\r\n", '""', ",", "word " * 9, '\\"', "\n"]
    wanted = {}
    for part in range(2):
        lines = [HEADER]
        for i in range(120):
            text = "".join(draw.choice(pieces) for _ in range(draw.randrange(6)))
            key = part * 1000 + i
            lines.append(line(key, channel=text))
            wanted[key] = text.replace('""', '"').replace('\\"', '"').strip(" ")
        (tmp_path / "in").mkdir(exist_ok=True)
        (tmp_path / "in" / f"{part}.csv").write_bytes(("\r\n".join(lines) + "\r\n").encode())
    names = {"spark.sql.files.maxPartitionBytes": "700b", "spark.sql.files.openCostInBytes": "1b"}
    for name, value in names.items():
        spark.conf.set(name, value)
    try:
        got = load_csv_table(spark, "fact_transactions", str(tmp_path / "in"), new_table_path(spark, "loaded"))
        found = {r["transaction_key"]: r["channel"] for r in got.accepted.collect()}
        assert got.rejected.count() == 0
    finally:
        for name in names:
            spark.conf.unset(name)
    assert found == wanted


def test_a_stray_quote_takes_nothing_along(spark, tmp_path):
    stray = line(2).replace('"Web"', '"Web')
    lines = [HEADER, line(1), stray, *[line(i).replace('"Web"', "Web") for i in range(3, 30)]]
    for most, also in ((1000, []), (5, [line(30)])):  # open at the end of the file; closed, but too long
        got = load(spark, tmp_path, lines + also, most_lines=most)
        assert sorted(r["transaction_key"] for r in got.accepted.collect()) == [1, *range(3, 31 if also else 30)]
        assert [r[0] for r in got.rejected.collect()] == [stray]


def test_a_header_over_two_lines_and_empty_lines(spark, tmp_path):
    got = load(spark, tmp_path, [HEADER.replace("channel", '"chan\r\nnel"'), "", line(1), "", line(2), ""])
    assert got.counts().first().asDict() == {"accepted_rows": 2, "rejected_rows": 0}


def test_the_text_of_lines_that_fit_is_not_written_again(spark, tmp_path, monkeypatch):
    """Only files with an open field keep all lines; elsewhere, those that do not fit."""
    kept = []

    def watched(frame, label, *codec):
        stored = write_table(frame, label, *codec)
        if label == "parsed-lines":
            kept.extend(r[0] for r in stored.filter("line is not null").select("line").collect())
        return stored

    monkeypatch.setattr(csv_load, "write_table", watched)
    (tmp_path / "in").mkdir()
    plain, open_field = [HEADER, line(1), "bad", "", line(2)], [HEADER, line(3, channel="a\r\nb"), line(4)]
    for name, lines in (("plain", plain), ("open", open_field)):
        (tmp_path / "in" / f"{name}.csv").write_bytes(("\r\n".join(lines) + "\r\n").encode())
    got = load_csv_table(spark, "fact_transactions", str(tmp_path / "in"), new_table_path(spark, "loaded"))
    assert {r["transaction_key"]: r["channel"] for r in got.accepted.collect()} == {1: "Web", 2: "Web", 3: "a\r\nb", 4: "Web"}
    assert raw(got.rejected) == [b"bad"]
    assert line(1) not in kept and {"bad", "", HEADER, line(4)} <= set(kept)
