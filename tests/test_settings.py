import json

import pytest

from palimp.plans import settings as S


def test_settings(tmp_path):
    assert S.load().chunker.target_words == 2000 and S.load().providers.of("judge") is not None
    with pytest.raises(FileNotFoundError):
        S.load(str(tmp_path / "none.yaml"))
    path = tmp_path / "s.json"
    path.write_text(json.dumps({"target_lang": "uk", "chunker": {"target_words": 150}, "providers": {"text": {"base_url": "a"}, "judge": {"base_url": "b", "max_response_bytes": 9}}, "reader_notes": {"enabled": True}}))
    held = S.load(str(path))
    assert held.target_lang == "uk" and held.chunker == S.Chunker(150, 1) and held.source_lang == "en"
    assert held.providers.of("judge").base_url == "b" and held.providers.of("style").base_url == "a" and held.providers.of("nonsense").base_url == "a"
    for bad in ({"colour": 1}, {"chunker": {"target_words": "many"}}, {"providers": []}, [1]):
        path.write_text(json.dumps(bad))
        with pytest.raises(S.SettingsError):
            S.load(str(path))


def test_notes_flags():
    off, on = S.Notes(), S.Notes(enabled=True, types=["place"])
    assert off.wanted() is None and off.wanted(True).enabled and on.wanted(False) is None and on.wanted().types == ["place"]
    assert on.wanted(None, "person, term").types == ["person", "term"] and on.types == ["place"]


def test_names():
    assert [S.extension(m) for m in ("image/png", "IMAGE/JPEG; q=1", None, "", "text/x", "image/webp")] == [".png", ".jpg", ".jpg", ".jpg", ".jpg", ".webp"]
    assert S.output_path("/a/b.c.epub", "ru") == "/a/b.c-ru.epub"


def test_glossary_files(tmp_path):
    path = S.init_series(str(tmp_path), "night", "Night", "A. Uthor")
    assert S.load_glossary(path)["entries"] == [] and S.load_glossary(path)["title"] == "Night"
    with pytest.raises(FileExistsError):
        S.init_series(str(tmp_path), "night", "Night", "A. Uthor")
    entry = {"original": "A", "translation": "\u0430", "type": "person", "approved_by_human": True}
    S.save_json([entry], str(tmp_path / "g" / "book.json"))
    assert S.load_glossary(str(tmp_path / "g" / "book.json"))["entries"][0]["approved_by_human"] is True
    for bad in ("{", "3", '[{"original": "A"}]', '{"entries": 1}'):
        (tmp_path / "bad.json").write_text(bad)
        with pytest.raises(S.SettingsError):
            S.load_glossary(str(tmp_path / "bad.json"))


def test_only_store(tmp_path):
    with pytest.raises(S.SettingsError):
        S.only_store(str(tmp_path))
    for name in ("one", "two"):
        (tmp_path / name).mkdir()
        (tmp_path / name / "revisions.parquet").write_text("")
        if name == "one":
            assert S.only_store(str(tmp_path)).endswith("one")
    with pytest.raises(S.SettingsError):
        S.only_store(str(tmp_path))
    assert S.only_store(str(tmp_path), "two").endswith("two")
