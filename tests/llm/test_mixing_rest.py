"""Values beyond the listed ones keep their share of the mix."""

import pytest

from tessera.llm import mixing, queries


def counted(spark, rows):
    return spark.createDataFrame([(i, s, lang, "prose", n) for i, (s, lang, n) in enumerate(rows)], "doc_id long, source string, lang string, topic string, n_tokens long")


@pytest.mark.parametrize("most", [3, 1000])
def test_sources_beyond_the_largest_are_drawn(spark, monkeypatch, most):
    monkeypatch.setattr(mixing, "MAX_VALUES", most)
    docs = counted(spark, [(f"s{i:02d}", "en", 100 - i) for i in range(20)])
    target = mixing.softened(docs, "source", 0.7)
    mass = {f"s{i:02d}": (100 - i) ** 0.7 for i in range(20)}
    assert len(target) == min(most + 1, 20) and sum(target.values()) == pytest.approx(1)
    if most == 3:
        assert target[mixing.OTHER] == pytest.approx(sum(list(mass.values())[3:]) / sum(mass.values()))
    got = mixing.mix(docs, queries.mix_targets(docs), 0.5).collect()
    assert len(got) == 20 and all(r.probability > 0 and r.weight > 0 for r in got)


def test_other_and_null_languages_are_drawn(spark):
    docs = mixing.token_counts(spark.createDataFrame([(i, 100, "src", lang, "t") for i, lang in enumerate(["en", "fr", "de", "es", "it", None] * 5)], "doc_id long, n_tokens long, source string, lang string, topic string"))
    target = queries.mix_targets(docs)["lang"]
    assert target == pytest.approx({"en": 0.55 * 2 / 3, "fr": 0.1, "de": 0.1, "es": 0.1, mixing.OTHER: 1 / 3})
    assert all(r.probability > 0 for r in mixing.mix(docs, {"lang": target}, 0.5).collect())
    assert mixing.with_rest(queries.MIX_LANGUAGES, docs.where("lang = 'en'"), "lang") == queries.MIX_LANGUAGES


def test_many_sources_are_all_drawn(spark):
    docs = counted(spark, [(f"s{i % 1500}", "en", 10) for i in range(3000)])
    got = mixing.mix(docs, queries.mix_targets(docs), 0.5).collect()
    assert len(got) == 3000 and all(r.probability > 0 for r in got)
