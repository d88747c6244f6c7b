"""Readers of markup against written-out results."""

import io
import zipfile

import pytest

from docloom.sources import extract, markup

PAGE = """<html><head><title>
  Edge &amp; Cases </title></head><body><nav><p>menu</p></nav>
<h1 id="  top  ">Top&nbsp;level &#128; heading</h1>
<p>one<p>two, after an unclosed paragraph</p>
<ul><li>first item<li>second item, unclosed</ul>
<ul><li><h2><span id=""></span><a id="deep"></a>Heading in a list</h2>item text</li></ul>
<table><tr><td>cell<p>paragraph in a cell</p></td></tr></table>
<pre>
outer<pre>inner</pre>tail
</pre>
<h3></h3><div>bare <b>run</b> of text<div>inner</div>after</div>
<p>kept <button>term</button> here</p><button>gone</button><span class="sr-only">gone</span>
<h4>​<a>Deep</a></h4><code>a
b</code></body></html>"""


def test_html():
    title, blocks = markup.html_blocks(PAGE)
    assert title == "Edge & Cases"
    top = "Top level € heading"
    assert [(b["text"], b["heading_path"], b["fragment"]) for b in blocks] == [
        ("one", [top], "top"),
        ("two, after an unclosed paragraph", [top], "top"),
        ("first item", [top], "top"),
        ("second item, unclosed", [top], "top"),
        ("Heading in a list item text", [top], "top"),
        ("cell paragraph in a cell", [top, "Heading in a list"], None),
        ("outerinnertail", [top, "Heading in a list"], None),
        ("bare run of text", [top, "Heading in a list"], None),
        ("inner", [top, "Heading in a list"], None),
        ("after", [top, "Heading in a list"], None),
        ("kept term here", [top, "Heading in a list"], None),
        ("a\nb", [top, "Heading in a list", "", "Deep"], None),
    ]
    assert blocks[1]["offset"] == 4


def test_title_needs_one_text():
    assert markup.html_blocks("<p>x", "stem") == ("stem", [{"heading_path": [], "fragment": None, "text": "x", "offset": 0}])
    assert markup.html_blocks("") == ("", [])


def test_markdown():
    source = "# Guide #\r\n\r\nfirst\nline\n\n### Deep\n```\n# not a heading\n\nstill\n```\n#no space\n"
    title, blocks = markup.markdown_blocks(source, "stem")
    assert title == "Guide"
    assert (blocks[0]["text"], blocks[0]["heading_path"], blocks[0]["offset"]) == ("first\nline", ["Guide"], 11)
    assert all(b["heading_path"] == ["Guide", "", "Deep"] for b in blocks[1:])
    assert blocks[1]["text"].startswith("```\n# not a heading") and blocks[-1]["text"].endswith("#no space")
    assert markup.markdown_blocks("plain", "stem")[0] == "stem"


def word_file(paragraphs):
    w = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f'<w:p><w:pPr><w:pStyle w:val="{s}"/></w:pPr><w:r>{x}</w:r></w:p>' for s, x in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {w}><w:body>{body}</w:body></w:document>")
        z.writestr("word/styles.xml", f'<w:styles {w}><w:style w:styleId="H1"><w:name w:val="heading 1"/></w:style></w:styles>')
    return out.getvalue()


def test_docx():
    content = word_file([("Title", "<w:t>Manual</w:t>"), ("H1", "<w:t>Part</w:t>"), ("Normal", "<w:t>a</w:t><w:tab/><w:t>b</w:t><w:br/><w:t>c</w:t>"), ("Heading 2", "<w:t>Sub</w:t>"), ("", "<w:t>d</w:t>"), ("", "<w:t> </w:t>")])
    title, blocks = markup.docx_blocks(content)
    assert title == "Manual"
    assert [(b["text"], b["heading_path"], b["offset"]) for b in blocks] == [("a\tb\nc", ["Part"], 0), ("d", ["Part", "Sub"], 6)]


def test_plain_offsets_count_code_points():
    _, blocks = markup.plain_blocks("é one\n\n\n\ntwo\r\n\r\n \n\nthree")
    assert [(b["text"], b["offset"]) for b in blocks] == [("é one", 0), ("two", 9), ("three", 17)]


def test_files_by_suffix(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "sub/a.MD").write_text("# T\n\nx")
    (tmp_path / "b.html").write_text("<h1>H</h1><p>y")
    (tmp_path / "c.txt").write_bytes(b"z \xff")
    (tmp_path / "d.docx").write_bytes(b"not a zip")
    (tmp_path / "e.bin").write_bytes(b"ignored")
    got = {r.path.rsplit("/", 1)[1]: r for r in extract.from_files(spark, str(tmp_path)).collect()}
    assert set(got) == {"a.MD", "b.html", "c.txt", "d.docx"}
    assert got["c.txt"].blocks[0].text == "z �" and got["d.docx"].error.startswith("BadZipFile") and got["d.docx"].blocks == []
    with pytest.raises(ValueError, match="supported: .docx"):
        markup.read_file("x.pdf", b"")
