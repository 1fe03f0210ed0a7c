from tidemill.sources.pdf import page_text, pdf_files, pdf_text, written
from tidemill.sources.readers import paired_lines


def test_text_of_a_page():
    assert page_text(rb"BT (Fund \(A\)) Tj 0 -14 Td [(Ri) -20 (sk)] TJ T* (caf\351) ' ET") == "Fund (A)\nRisk\ncafé"
    assert page_text(b"BT <FEFF6295> Tj 4 0 Td <4FE1> Tj ET") == "投信"
    assert pdf_text(None) == pdf_text(b"") == pdf_text(b"plain text") == "" and pdf_text(b"%PDF-1.4 without pages") == ""


def test_documents_become_rows(spark, tmp_path):
    lines = ["基準価額", "信託報酬", "", "10,234", "0.5", "ファンド名", "Juniper"]
    for name, packed in (("a", True), ("b", False)):
        (tmp_path / f"{name}.pdf").write_bytes(written(lines, packed))
    (tmp_path / "c.pdf").write_bytes(b"broken")
    docs = pdf_files(spark, str(tmp_path / "*.pdf"))
    got = sorted(tuple(r)[1:] for r in paired_lines(docs, "path", "text").collect())
    assert got == sorted([("基準価額", "10,234"), ("信託報酬", "0.5"), ("ファンド名", "Juniper")] * 2)
