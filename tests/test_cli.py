"""Command line: options, messages, exit codes, files, and the drop folder."""

import pytest
from packages import document, package, para, run

from vellumflow.plans import cli
from vellumflow.streaming import drop_folder


@pytest.mark.parametrize(("arguments", "message"), [
    ([], "no input"), (["-q"], "no input"), (["-o"], "requires a value"), (["--output="], "is empty"), (["-o", ""], "is empty"), (["-j", "0", "a"], "whole number"), (["-j", "x", "a"], "whole number"), (["--threads=99", "a"], "must be 1 to 4"),
    (["--hard-break=x", "a"], "backslash or spaces"), (["", "a"], "empty argument"), (["-x", "a"], "unrecognised"), (["--outputs=x", "a"], "unrecognised"), (["-o=x", "a"], "unrecognised"), (["--stdout", "a", "b"], "single"), (["--stdout", "-o", "x", "a"], "both"), (["-z", "--help"], "unrecognised"),
])
def test_usage_errors(arguments, message):
    with pytest.raises(cli.UsageError, match=message):
        cli.parse(arguments, cores=4)


def test_options():
    got = cli.parse(["-q", "--output=o", "-j", "3", "--media-dir", "m", "--no-images", "--hard-break", "spaces", "a", "-o", "-b"], cores=4)
    assert (got.quiet, got.output, got.threads, got.media_dir, got.images, got.policies, got.inputs) == (True, "-b", 3, "m", False, {"hard_break": "spaces"}, ["a"])
    more = cli.parse(["--underline=u", "--tables", "flat", "--ascii-punct", "--image-size", "--no-break=entity", "--crlf", "--bom", "a"], cores=4)
    assert more.policies == {"underline": "u", "tables": "flat", "ascii_punct": True, "image_size": True, "no_break": "entity"} and more.crlf and more.bom
    assert cli.parse(["--version", "-z"]).show == "version" and cli.parse(["-h"]).show == "help" and cli.parse(["a"], cores=4).threads == 4


def test_main(spark, tmp_path, capsys):
    (tmp_path / "a.docx").write_bytes(package(document(para(run("hello")))))
    (tmp_path / "bad.docx").write_bytes(b"nothing")
    at = lambda n: f"file:{tmp_path}/{n}"
    assert cli.main([]) == 1 and "Usage" in capsys.readouterr().err
    assert cli.main(["--version"]) == 0 and cli.VERSION in capsys.readouterr().out
    assert cli.main([at("missing.docx"), at("a.docx"), at("gone.docx")], spark) == 2
    err = capsys.readouterr().err
    assert "missing.docx" in err and "gone.docx" in err
    assert cli.main(["--stdout", at("a.docx")], spark) == 0 and capsys.readouterr().out == "hello\n"
    assert cli.main(["-o", f"{tmp_path}/out", at("a.docx"), at("bad.docx")], spark) == 6
    assert (tmp_path / "out" / "a.md").read_bytes() == b"hello\n" and "bad.docx" in capsys.readouterr().err
    assert cli.main(["-o", f"{tmp_path}/b.md", at("bad.docx")], spark) == 3


def test_pictures_and_names_keep_apart(spark, tmp_path):
    """Documents of one name, each with its own image1.png, in one output folder."""
    blip = '<w:drawing><wp:inline><wp:docPr id="1" name="P"/><a:graphic><a:graphicData uri="x/picture"><pic:pic><pic:blipFill><a:blip r:embed="rIdI"/></pic:blipFill></pic:pic></a:graphicData></a:graphic></wp:inline></w:drawing>'
    at = []
    for k in "xy":
        (tmp_path / k).mkdir()
        made = package(document(para(run(k), f"<w:r>{blip}</w:r>")), links=[("rIdI", "image", "media/pic.png")], extra={"word/media/pic.png": k.encode()})
        (tmp_path / k / "a.docx").write_bytes(made)
        at.append(f"file:{tmp_path}/{k}/a.docx")
    assert cli.main(["-o", f"{tmp_path}/out", *at], spark) == 0
    out = tmp_path / "out"
    assert sorted(p.name for p in out.iterdir()) == ["a-1.md", "a-1_media", "a.md", "a_media"]
    assert {(out / f"{n}_media" / "image1.png").read_bytes() for n in ("a", "a-1")} == {b"x", b"y"}
    for n in ("a", "a-1"):
        k = (out / f"{n}_media" / "image1.png").read_text()
        assert (out / f"{n}.md").read_text() == f"{k}![P]({n}_media/image1.png)\n"
    assert cli.main(["--media-dir=pics", "--crlf", "--bom", *at], spark) == 0
    assert (tmp_path / "x" / "pics" / "a" / "image1.png").read_bytes() == b"x" and (tmp_path / "y" / "a.md").read_bytes() == b"\xef\xbb\xbfy![P](pics/a/image1.png)\r\n"


def test_drop_folder(spark, tmp_path):
    (tmp_path / "in").mkdir()
    args = (spark, str(tmp_path / "in"), str(tmp_path / "out"), str(tmp_path / "state"))
    (tmp_path / "in" / "a.docx").write_bytes(package(document(para(run("one")))))
    drop_folder.convert_stream(*args).awaitTermination()
    (tmp_path / "in" / "b.docx").write_bytes(package(document(para(run("two")))))
    drop_folder.convert_stream(*args).awaitTermination()
    assert sorted((r["batch"], r["markdown"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == [(0, "one\n"), (1, "two\n")]
