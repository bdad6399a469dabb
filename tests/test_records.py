"""Files read in splits give what whole files give, whatever the split cuts through."""

import random

import pytest
from pyspark.sql import functions as F

from ledgerloom.sources import records, statements


def movement(kind, k, rng):
    day, text = f"{1 + k % 28:02d}", "".join(rng.choice("abc é") for _ in range(rng.randrange(0, 90))).strip()
    if kind == "camt":
        tag = "n:Ntry" if k % 2 else "Ntry"
        opened = f"<{tag} id='{k}'>" if k % 5 == 0 else f"<{tag}>"
        p = "n:" if k % 2 else ""
        return f"{opened}<{p}NtryRef>r{k}</{p}NtryRef><{p}Amt Ccy='EUR'>{k}.10</{p}Amt><{p}CdtDbtInd>{'DBIT' if k % 3 else 'CRDT'}</{p}CdtDbtInd><{p}BookgDt><{p}Dt>2024-01-{day}</{p}Dt></{p}BookgDt><{p}AddtlNtryInf>{text}</{p}AddtlNtryInf></{tag}>\n" + ("</Stmt><Stmt>" if k % 40 == 0 else "")
    if kind == "ofx":
        return f"<STMTTRN><TRNAMT>{k}.05\n<DTPOSTED>202401{day}\n<FITID>f{k}\n<MEMO>{text}\n</STMTTRN>\n" + ("junk between\n" if k % 9 == 0 else "")
    if kind == "mt940":
        return f":61:2401{day}01{day}C{k},1NTRFref{k}//B\n:86:{text}\nmore {k}\n" + (f":62F:C2401{day}EUR0,00\n:20:next\n" if k % 30 == 0 else "")
    head = f"1100{k:010d}{'USD' if k % 2 else '978'}\n" if k % 25 == 0 else ""
    return head + f"22        2401{day}2401{day}99999{1 + k % 2}{k:014d}{k:<10d}{text}\n2301more {text}\n" + ("2401978" + "0" * 14 + "\n" if k % 7 == 0 else "") + ("33000000\n88999999\n2301lost\n" if k % 25 == 24 else "")


PARSE = {"camt": statements.parse_camt, "ofx": statements.parse_ofx, "mt940": statements.parse_mt940, "norma43": statements.parse_norma43}


@pytest.fixture
def small_splits(spark):
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4k")
    spark.conf.set("spark.sql.files.openCostInBytes", "0")
    yield
    spark.conf.unset("spark.sql.files.maxPartitionBytes")
    spark.conf.unset("spark.sql.files.openCostInBytes")


@pytest.mark.parametrize("end", ["\n", "\r\n"])
@pytest.mark.parametrize("kind", sorted(PARSE))
def test_splits(spark, tmp_path, small_splits, kind, end):
    rng = random.Random(kind)
    opens = {"camt": "<Document><Stmt>", "ofx": "OFXHEADER:100\n<OFX>\n", "mt940": ":20:x\n:25:y\n", "norma43": "0000\n"}[kind]
    for name, n in (("long", 400), ("short", 2), ("other", 130)):
        body = opens + "".join(movement(kind, k, rng) for k in range(n)) + ("</Stmt></Document>" if kind == "camt" else "")
        (tmp_path / f"{name}.txt").write_bytes(body.replace("\n", end).encode("latin-1" if name == "other" else "utf-8"))
    (tmp_path / "empty.txt").write_bytes(b"")
    moves = records.read_movements(spark, str(tmp_path), kind)
    assert moves.select("file", "block").distinct().count() > 10
    bare = lambda df: sorted(map(str, df.withColumn("file", F.element_at(F.split("file", "/"), -1)).collect()))
    got, want = bare(PARSE[kind](moves)), bare(PARSE[kind](statements.read_files(spark, str(tmp_path))))
    assert len(want) == 532 and got == want


@pytest.mark.parametrize("parse", [statements.parse_emc, statements.parse_bit_recon, lambda f: statements.parse_mapped(f, {"date": 0, "description": 1, "amount": 2})])
def test_lines(spark, tmp_path, small_splits, parse):
    rows = ["EMC13USD", *(f"EMC23202401{1 + k % 28:02d}CC{k:016d}text {k}" if k % 60 else f"EMC13{'EUR' if k % 120 else 'GBP'}" for k in range(1, 600))]
    rows += [f"202401{1 + k % 28:02d} text {k},x {k},00D 7,00C" for k in range(300)] + [f"{1 + k % 28:02d}-01-2024;t {k};{k},5" for k in range(300)]
    (tmp_path / "a.txt").write_text("﻿" + "\n".join(rows) + "\n")
    (tmp_path / "b.txt").write_text("\r\n".join(rows[500:1000]))
    lines = records.read_lines(spark, str(tmp_path))
    assert lines.select("block").distinct().count() > 5
    got, want = (sorted(map(str, parse(f).withColumn("file", F.element_at(F.split("file", "/"), -1)).collect())) for f in (lines, statements.read_files(spark, str(tmp_path))))
    assert got == want and len(got) > 250


def test_norma43_signature(spark):
    """A sheet of the 22nd to 24th of a month is no Norma43 file; names tell where lines do not."""
    sheet = "Data;Valor;Texto\n" + "\n".join(f"{d}-03-2024;{d}-03-2024;x;1,00" for d in (22, 23, 24, 22, 23, 24))
    real = "11000000000000000000USD\n22        240101240101999991" + "0" * 14 + "ref\n2301SOMETHING\n33000000000\n"
    files = [("sheet.csv", sheet), ("a.txt", real), ("banco_978.txt", real), ("Registo 24.txt", real), ("x978.txt", real.replace("2301", "2401978")), ("y.txt", real.replace("USD", "978"))]
    got = {r["file"]: r["format"] for r in statements.detect_format(spark.createDataFrame(files, "file string, content string")).collect()}
    assert got == {"sheet.csv": "csv", "a.txt": "norma43", "banco_978.txt": "norma43_978", "Registo 24.txt": "norma43_r24", "x978.txt": "norma43_r24", "y.txt": "norma43_978"}
