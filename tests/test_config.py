import pytest

from lorequarry import config
from lorequarry.errors import EXIT_CODES, KnowledgeError, code_of


def test_defaults_and_toml(tmp_path):
    assert config.Config().chunking == config.Chunking(512, 64)
    path = tmp_path / "c.toml"
    path.write_text('search = { rrf_k = 10 }\n[embedding]\nonnx_path = "mock"\ndimension = 8\nunknown = 1\n[upload]\nallowed_dirs = ["/a"]\n')
    c = config.load(path, env={"LOREQUARRY_SEARCH__TOP_K": "7", "LOREQUARRY_STORAGE__PATH": "/x"})
    assert (c.search.rrf_k, c.search.top_k, c.embedding.dimension, c.storage.path, c.upload.allowed_dirs) == (10, 7, 8, "/x", ("/a",))


@pytest.mark.parametrize("text,code", [("[storage]\nmode = 'remote'", "E_CONFIG"), ("x = [", "E_CONFIG"), ("[search]\ntop_k = 'a'", "E_CONFIG"), ("search = 1", "E_CONFIG"), ("[chunking]\nmax_tokens = 4\noverlap_tokens = 4", "E_VALIDATION")])
def test_invalid(text, code):
    with pytest.raises(KnowledgeError) as e:
        config.from_toml(text)
    assert e.value.code == code


def test_missing_file():
    with pytest.raises(KnowledgeError):
        config.load("/no/such/file.toml")


@pytest.mark.parametrize(
    "before,key,value,after",
    [
        ("search = { rrf_k = 10 }\n", "search.rrf_k", "42", "search = { rrf_k = 42 }\n"),
        ("search = { rrf_k = 10 }\n", "search.top_k", "3", "search = { rrf_k = 10, top_k = 3 }\n"),
        ("# head\n[search]  # s\nrrf_k = 10 # k\n\n[upload]\n", "search.rrf_k", "1", "# head\n[search]  # s\nrrf_k = 1 # k\n\n[upload]\n"),
        ("[search]\nrrf_k = 10\n", "search.top_k", "3", "[search]\ntop_k = 3\nrrf_k = 10\n"),
        ("", "storage.path", "/a\\b", '[storage]\npath = "/a\\\\b"\n'),
    ],
)
def test_set_key_keeps_the_rest(before, key, value, after):
    assert config.set_key(before, key, value) == after


def test_scalars():
    assert [config.parse_scalar(x) for x in ("true", "3", "0.5", "x")] == [True, 3, 0.5, "x"]


def test_filters():
    assert config.parse_filters(["a=1,b=2", "c=x=y"]) == {"a": "1", "b": "2", "c": "x=y"}
    for bad in ("a", "=1"):
        with pytest.raises(KnowledgeError):
            config.parse_filters([bad])


def test_codes():
    assert len(EXIT_CODES) == 9 and sorted(EXIT_CODES.values()) == list(range(2, 11))
    try:
        try:
            raise KnowledgeError("E_IO", "x")
        except KnowledgeError as e:
            raise RuntimeError from e
    except RuntimeError as e:
        assert code_of(e) == ("E_IO", 5)
    assert code_of(ValueError()) == ("E_INTERNAL", 1)
