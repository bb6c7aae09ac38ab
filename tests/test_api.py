import lexloom.api as api


def test_names_are_there():
    assert len(api.__all__) > 100
    assert all(getattr(api, n) is not None for n in api.__all__)


def test_the_rest_stands_without_the_corpus_operators():
    import pathlib
    import re

    root = pathlib.Path(api.__file__).parent
    for path in root.rglob("*.py"):
        if path.relative_to(root).parts[0] != "llm":
            assert not re.search(r"^\s*(from|import).*\bllm\b", path.read_text(encoding="utf-8"), re.M), path
