import json

import pytest

from rambleweave.__main__ import VERSION, main


def test_commands(spark, tmp_path, capsys):
    assert main(["version"]) == 0 and capsys.readouterr().out.strip() == VERSION
    for name, text in {"a.md": "# Alpha\n[[b]] [[gone]]", "b.md": "# Beta\n[[c]]", "c.md": "x", **{f"p{i}.md": "y" for i in range(5)}}.items():
        (tmp_path / name).write_text(text)
    assert main(["refresh", str(tmp_path), "--json"]) == 0
    assert json.loads(capsys.readouterr().out)["added"] == 8
    assert main(["index", str(tmp_path), "--json"]) == 0
    got = json.loads(capsys.readouterr().out)
    assert got["nodes"] == 8 and got["dangling"] == [{"source": "a", "target": "gone"}] and got["types"] == {"note": 8}
    assert main(["roam", str(tmp_path), "Alpha", "--top=3"]) == 0
    assert "**Beta**" in capsys.readouterr().out
    assert main(["profile-detect", str(tmp_path)]) == 0 and "title_keys" in capsys.readouterr().out
    assert main(["index", str(tmp_path), "--profile-name", "none"]) == 1
    with pytest.raises(SystemExit) as e:
        main(["unknown"])
    assert e.value.code == 2
