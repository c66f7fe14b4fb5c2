import json

import pytest

from reviewloom.params import Params, load_params


def write(tmp_path, content):
    path = tmp_path / "params.json"
    path.write_text(json.dumps(content), encoding="utf-8")
    return str(path)


def test_flat_file(tmp_path):
    params = load_params(write(tmp_path, {"min_tokens": 7, "lda_labels": {"0": "a"}, "lda_constructs": {"0": ["c", "i"]}}))
    assert params.min_tokens == 7 and params.lda_labels == {0: "a"} and params.lda_constructs == {0: ("c", "i")}
    assert params.max_star == Params().max_star


def test_sections(tmp_path):
    content = {
        "data": {"source_excel": "x", "sheet_name": "y"},
        "analysis": {"min_star": 2, "random_state": 1, "bertopic_min_topic_size": 9, "brand_order": ["B"], "lda_top_words": 4},
        "sentiment": {"positive_threshold": 0.2},
        "aspects": {"a": ["x"]},
        "publication_labels": {"lda": {"0": "zero"}, "bertopic": {"0": "unused"}},
        "construct_mapping": {"lda": {"0": {"primary_construct": "c", "interpretation": "i"}}},
    }
    params = load_params(write(tmp_path, content))
    assert (params.min_star, params.seed, params.min_topic_size, params.top_words) == (2, 1, 9, 4)
    assert params.brand_order == ["B"] and params.positive_threshold == 0.2 and params.aspects == {"a": ["x"]}
    assert params.lda_labels == {0: "zero"} and params.lda_constructs == {0: ("c", "i")}


def test_unknown_name_is_an_error(tmp_path):
    with pytest.raises(ValueError, match="min_toekns"):
        load_params(write(tmp_path, {"min_toekns": 7}))


def test_changes_leave_the_defaults_alone():
    assert Params().with_(min_tokens=1).min_tokens == 1 and Params().min_tokens == 5
