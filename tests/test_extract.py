"""Texts out of small files of every format, broken files, and walking a folder."""

import base64
import email.message
import io
import struct
import zipfile
import zlib

from pyspark.sql import functions as F

from spindrift.sources import sinks, walk
from spindrift.sources.encoding import decode
from spindrift.sources.extract import extract, folder_texts, html, indexed_texts, rtf, unpacked_rtf


def box(parts):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        for name, text in parts.items():
            z.writestr(name, text)
    return out.getvalue()


def test_encodings():
    text = "Größe für Übung — и это"
    for raw in (text.encode(), b"\xef\xbb\xbf" + text.encode(), b"\xff\xfe" + text.encode("utf-16-le"), b"\xfe\xff" + text.encode("utf-16-be")):
        assert decode(raw)[0] == text
    assert decode("plain ascii text".encode("utf-16-le"))[0] == "plain ascii text"
    assert decode("Größe".encode("cp1252"))[0] == "Größe" and decode("это".encode("cp866"), "IBM866 ")[0] == "это"
    assert decode(("x" * 40 + "é").encode()[:-1]) == ("x" * 40, "utf-8", True)


def test_containers():
    word = box(
        {
            "word/document.xml": '<w:document xmlns:w="w"><w:p><w:r><w:t>Hello</w:t></w:r></w:p><w:p><w:r><w:t>World</w:t></w:r></w:p></w:document>',
            "word/media/x.png": "no"
        }
    )
    assert extract("a.docx", word)[:2] == ("Hello\nWorld", 2)
    assert extract("a.xlsx", box({"xl/sharedStrings.xml": "<sst><si><t>cell</t></si></sst>"}))[0] == "cell"
    assert extract("a.odt", box({"content.xml": "<d><p>one <span>two</span> three</p></d>"}))[0].split() == ["one", "two", "three"]
    assert extract("a.epub", box({"OEBPS/c1.xhtml": "<html><body><p>chapter</p></body></html>"}))[0] == "chapter"


def test_html_keeps_its_source_and_mail_renders_it():
    assert html(b"<p>caf\xe9</p><meta charset=latin1>") == "<p>café</p><meta charset=latin1>"
    m = email.message.EmailMessage()
    m["From"], m["Subject"] = "a@b", "Grüße"
    m.set_content("plain part")
    m.add_alternative("<p>rich <b>part</b></p><script>no</script>", subtype="html")
    m.add_attachment(b"secret", maintype="text", subtype="plain", filename="x.txt")
    text = extract("a.eml", m.as_bytes())[0]
    assert "Subject: Grüße" in text and "plain part" in text and "rich part" in text and "secret" not in text and "no" not in text.split()
    assert extract("a.mbox", b"From x\n" + m.as_bytes() + b"\nFrom y\nSubject: two\n\n>From here\n")[0].count("Subject:") == 2


def test_rtf():
    assert rtf(rb"{\rtf1\ansi\ansicpg1252{\fonttbl{\f0 Arial;}}Gr\'f6\'dfe\par {\*\generator x}\u8364? end\tab x}") == "Größe\n€ end\tx"
    raw = rb"{\rtf1 stored}"
    assert unpacked_rtf(struct.pack("<4I", len(raw) + 12, len(raw), 0x414C454D, 0) + raw) == raw


def test_pdf():
    page = zlib.compress(b"BT /F1 12 Tf (Hello) Tj 0 -14 Td [(Wo) -20 (rld) -400 (again\\051)] TJ ET")
    raw = b"%PDF-1.4\n1 0 obj\n<< /Length " + str(len(page)).encode() + b" /Filter /FlateDecode >>\nstream\n" + page + b"\nendstream endobj"
    assert extract("a.pdf", raw)[0].split() == ["Hello", "World", "again)"]
    assert extract("no-extension", raw)[1] == 3


def _packed(data):
    """Codes of 9 to 12 bits as writers of the format make them."""
    table, bits, word = {bytes([i]): i for i in range(256)}, [format(256, "09b")], b""
    width, following = 9, 258
    for c in data:
        c = bytes([c])
        if word + c in table:
            word += c
            continue
        bits.append(format(table[word], f"0{width}b"))
        table[word + c] = following
        following += 1
        if following == 4095:
            bits.append(format(256, "012b"))
            table, width, following = {bytes([i]): i for i in range(256)}, 9, 258
        else:
            width = min(12, max(9, following.bit_length()))
        word = c
    bits += [format(table[word], f"0{width}b"), format(257, f"0{width}b")]
    all_bits = "".join(bits)
    return bytes(int(all_bits[i : i + 8].ljust(8, "0"), 2) for i in range(0, len(all_bits), 8))


def test_pdf_streams_in_other_encodings():
    text = b"BT " + b" ".join(b"(word%d) Tj T*" % i for i in range(900)) + b" ET"
    runs = b"".join(bytes([len(text[i : i + 100]) - 1]) + text[i : i + 100] for i in range(0, len(text), 100)) + b"\x80"
    ways = {
        "/ASCIIHexDecode": text.hex().encode() + b">", "/ASCII85Decode": base64.a85encode(text) + b"~>", "/RunLengthDecode": runs,
        "/LZWDecode": _packed(text), "[/ASCII85Decode /FlateDecode]": base64.a85encode(zlib.compress(text)) + b"~>"
    }
    for name, raw in ways.items():
        found = extract(
            "a.pdf", b"%PDF-1.4\n1 0 obj\n<< /X (" + b"y" * 9000 + b") /Filter " + name.encode() + b" >>\nstream\n" + raw + b"\nendstream endobj"
        )
        assert found[0].split() == [f"word{i}" for i in range(900)] and not found[3], name
    lost = extract("a.pdf", b"%PDF-1.4\n1 0 obj\n<< /Filter /StrangeDecode >>\nstream\nx\nendstream endobj")
    assert lost[3] and not lost[2]
    image = extract("a.pdf", b"%PDF-1.4\n1 0 obj\n<< /Subtype /Image /Filter /DCTDecode >>\nstream\nx\nendstream endobj")
    assert not image[3]


def test_walks_hand_over_what_they_have_not_read(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(walk, "SHARE", 3)
    for i in range(4):
        for j in range(3):
            (tmp_path / f"d{i}" / f"e{j}").mkdir(parents=True)
            (tmp_path / f"d{i}" / f"e{j}" / "f.txt").write_text("x")
    (tmp_path / "loop").symlink_to(tmp_path)
    names = sorted(r["path"] for r in walk.walk(spark, [str(tmp_path)]).collect())
    assert len(names) == len(set(names)) == 4 + 12 + 12 + 1


def test_broken_and_binary_files_are_skipped():
    for name in ("a.docx", "a.pdf", "a.msg", "a.rtf", "a.eml", "a.html"):
        assert isinstance(extract(name, b"\x00\xff garbage")[2], bool)
    assert extract("a.docx", b"no zip")[2] and extract("a.msg", b"no")[5]
    assert extract("a.bin", b"ab\0cd")[4] and extract("a.txt", b"")[0] == ""


def test_folders(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub" / "a.txt").write_text("text")
    (tmp_path / "b.html").write_text("<p>x</p>")
    (tmp_path / "queries.txt").write_text("# comment\n\next:md  # no\n a b \n")
    got = {r["path"].rsplit("/", 1)[-1]: r["text"] for r in folder_texts(spark, str(tmp_path)).collect()}
    assert got["a.txt"] == "text" and got["b.html"] == "<p>x</p>"
    seen = {r["name"]: r["is_dir"] for r in walk.walk(spark, [str(tmp_path), str(tmp_path / "missing")]).collect()}
    assert seen == {"sub": True, "a.txt": False, "b.html": False, "queries.txt": False}
    assert walk.walk(spark, []).count() == 0
    assert all(r["exists"] for r in walk.exists(walk.walk(spark, [str(tmp_path)])).collect())
    found, complete = walk.fallback(spark, str(tmp_path))
    assert found.count() == 4 and complete and not walk.fallback(spark, str(tmp_path), visits=1)[1]
    texts = {
        r["path"].rsplit("/", 1)[-1]: r["text"]
        for r in indexed_texts(walk.walk(spark, [str(tmp_path)]).withColumn("path", F.translate("path", "\\", "/"))).collect()
    }
    assert texts["a.txt"] == "text" and len(texts) == 3
    sinks.write_paths(found, str(tmp_path / "out"))
    sinks.write_index(found, str(tmp_path / "index"))
    sinks.write_json(found.select("name"), str(tmp_path / "json"))
    assert spark.read.text(str(tmp_path / "out")).count() == 4 == spark.read.parquet(
        str(tmp_path / "index")
    ).count() == spark.read.json(str(tmp_path / "json")).count()
    assert walk.queries_of(str(tmp_path / "queries.txt")) == ["ext:md  # no", "a b"]
