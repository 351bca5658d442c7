import json
import zipfile

import pytest
from conftest import DATA, rows

from lexstrata.sources import files, sinks


def test_landed_files(spark, tmp_path):
    log = tmp_path / "log.jsonl"
    log.write_text('{"hs":"01","tpcd":"1","items":[{"dcerCfrmLworCd":"A"}]}\n{"hs":"02","tpcd":"2","items":[]}\n{"hs":"03","tp')
    assert rows(files.sweep_log(spark, str(log)), "hs") == [("01",), ("02",)]
    pages = tmp_path / "pages"
    pages.mkdir()
    law = {"법령ID": "1", "법령일련번호": "9", "시행일자": "20240101"}
    for i, value in enumerate([law, [law, {**law, "법령ID": "2"}], None, []]):
        (pages / f"{i}.json").write_text(json.dumps({"LawSearch": {"totalCnt": "1", "law": value}}))
    (pages / "x.json").write_text('{"LawSearch": {"totalCnt": "0"}}')
    (pages / "torn.json").write_text('{"LawSe')
    assert rows(files.change_pages(spark, str(pages)), "법령ID", "공포일자") == [("1", None), ("1", None), ("2", None)]
    assert files.law_bodies(spark, str(pages)).count() == 6
    sheet = tmp_path / "leaf.csv"
    sheet.write_text("HS부호,적용시작일자,적용종료일자,수량단위코드,중량단위코드,성질통합분류코드,성질통합분류코드명\n0101210000,20240101,x,U,KG,1,말\n0101,20240101,20250101,,,,\n")
    assert rows(files.leaf_sheet(spark, str(sheet)), "code", "valid_from", "valid_to") == [("0101210000", "2024-01-01", None)]
    laws = spark.createDataFrame([("2", "하천법  시행령"), ("1", "하천법")], "law_id string, law_name string")
    assert rows(files.find_law(laws, "하천법시행령"), "law_id") == [("2",)]
    assert rows(files.find_laws(laws, spark.createDataFrame([("하 천법",), ("x",)], "name string"))) == [("x", None), ("하 천법", "1")]
    assert "법령ID" in files.structure(spark.createDataFrame([(json.dumps(law),)], "b string"), "b")


def test_requirement_answers(spark):
    item = "<item><dcerCfrmLworCd>A1</dcerCfrmLworCd></item>"
    ok = "<response><header><resultCode>{}</resultCode><resultMsg>m</resultMsg></header><body><items>{}</items></body></response>"
    gateway = "<OpenAPI_ServiceResponse><cmmMsgHeader><returnReasonCode>{}</returnReasonCode><returnAuthMsg>g</returnAuthMsg></cmmMsgHeader></OpenAPI_ServiceResponse>"
    texts = [ok.format("00", item), ok.format("00", item * 3), ok.format("00", ""), ok.format(" 22 ", ""), ok.format("99", item), gateway.format("23"), gateway.format("30"), "no xml", None]
    got = files.requirement_answer(spark.createDataFrame(list(enumerate(texts)), "i int, x string"), "x").orderBy("i").collect()
    assert [(r.answer.status, r.answer.reason, len(r.answer["items"])) for r in got[:7]] == [("ok", None, 1), ("ok", None, 3), ("ok", None, 0), ("quota", "m", 0), ("error", "m", 0), ("quota", "g", 0), ("error", "g", 0)]
    assert {r.answer.status for r in got[7:]} == {"error"}
    assert got[0].answer["items"][0].dcerCfrmLworCd == "A1"


def write_workbook(path, sheets):
    """A minimal XLSX: {name: rows}; every second text shared, the others inline."""
    shared, parts = [], {}
    for n, rows_ in enumerate(sheets.values(), 1):
        lines = []
        for r, cells in enumerate(rows_, 1):
            out = ""
            for c, v in enumerate(cells):
                ref = f'{chr(65 + c)}{r}'
                if v is None:
                    continue
                if isinstance(v, int):
                    out += f'<c r="{ref}"><v>{v}</v></c>'
                elif (r + c) % 2:
                    shared.append(v)
                    out += f'<c r="{ref}" t="s"><v>{len(shared) - 1}</v></c>'
                else:
                    out += f'<c r="{ref}" t="inlineStr"><is><t>{v}</t></is></c>'
            lines.append(f'<row r="{r}">{out}</row>')
        parts[f"xl/worksheets/sheet{n}.xml"] = f'<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{"".join(lines)}</sheetData></worksheet>'
    names = "".join(f'<sheet name="{k}" sheetId="{n}" r:id="rId{n}"/>' for n, k in enumerate(sheets, 1))
    parts["xl/workbook.xml"] = f'<workbook xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main" xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"><sheets>{names}</sheets></workbook>'
    rels = "".join(f'<Relationship Id="rId{n}" Target="worksheets/sheet{n}.xml"/>' for n in range(1, len(sheets) + 1))
    parts["xl/_rels/workbook.xml.rels"] = f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">{rels}</Relationships>'
    parts["xl/sharedStrings.xml"] = '<sst xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main">' + "".join(f"<si><r><t>{t}</t></r></si>" for t in shared) + "</sst>"
    with zipfile.ZipFile(path, "w") as book:
        for name, body in parts.items():
            book.writestr(name, body)


def test_workbooks(spark, tmp_path):
    write_workbook(tmp_path / "a.xlsx", {"chapters": [["code", "ko", "en"], ["01", "말", "horse"], ["02", None, "cow"]], "leaves": [["code", "ko", "en"], ["0101210000", "종마", None], [7, "수", "seven"]], "none": []})
    book = files.workbook(spark, str(tmp_path / "a.xlsx"))
    got = rows(files.workbook_sheets(book, ["code", "name_ko", "name_en"]), "sheet", "code", "name_ko", "name_en")
    assert got == [("chapters", "01", "말", "horse"), ("chapters", "02", None, "cow"), ("leaves", "0101210000", "종마", None), ("leaves", "7", "수", "seven")]
    with pytest.raises(Exception, match="more columns"):
        files.workbook_sheets(book, ["code"]).collect()


def test_a_leaf_given_twice(spark, tmp_path):
    sheet = tmp_path / "leaf.csv"
    sheet.write_text("HS부호,적용시작일자,적용종료일자,수량단위코드,중량단위코드,성질통합분류코드,성질통합분류코드명\n0101210000,,,,,,\n 0101210000 ,,,,,,\n")
    with pytest.raises(Exception, match="given twice"):
        files.leaf_sheet(spark, str(sheet)).collect()


def test_read_through(spark, tmp_path):
    made = []

    def make(n):
        return lambda: (made.append(n), spark.range(n))[1]

    cache = str(tmp_path / "cache")
    assert [files.read_through(spark, cache, make(n), use).count() for n, use in ((2, True), (3, True), (4, False), (5, True))] == [2, 2, 4, 4]
    assert made == [2, 4]


def test_current_version(spark):
    found = spark.createDataFrame([("1", "a", 1), ("1", "b", 2), ("2", None, 3)], "law_id string, mst string, seq int")
    assert files.current_version(found, "1") == "b"
    with pytest.raises(LookupError):
        files.current_version(found, "2")
    assert rows(files.current_versions(found.where("law_id = '1'"), found)) == [("1", "b")]
    with pytest.raises(Exception, match="no version of law 2"):
        files.current_versions(found, found).collect()


def test_structure_walk(spark):
    df = spark.createDataFrame([('{"a ": {"b": [{"c": 1}, {"d": 2}]}, "e": null}',), ("{",), (None,), ("[]",)], "b string")
    assert rows(files.structure_walk(df, "b")) == [("/a", "dict", 1, 1, 1), ("/a/b", "list", 1, 2, 2), ("/a/b/c", "int", 1, None, None), ("/e", "NoneType", 1, None, None)]


def test_sinks(spark, tmp_path):
    import datetime as dt

    chunks = spark.createDataFrame([("L", 502, None, "t", "c", dt.date(2024, 1, 1))], "law_id string, article_no int, paragraph_no int, title string, content string, valid_from date")
    for _ in range(2):
        sinks.append_json(sinks.chunk_records(chunks), str(tmp_path / "out"))
    back = spark.read.json(str(tmp_path / "out"))
    assert rows(back, "id", "metadata.enforcement_date") == [("L-5-2", "2024-01-01")] * 2


def test_repository(spark):
    from lexstrata.api import Repository

    repo = Repository(spark, DATA)
    assert repo.search("물품 준설", "bm25", 3).count() == 3
    assert repo.search("물품 준설", "dense", 3).count() == 3
    assert repo.search("물품 준설", "bm25", 3, "2024-01-01").columns == ["article_pk", "score", "text"]
    assert repo.resolve_as_of("900001", 100, None, "1900-01-01").count() == 0
    assert repo.hsk_requirements("8542").first().hsk10 == "8542000000"
    assert repo.expand_article(-1).count() == 0
