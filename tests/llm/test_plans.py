"""What the physical plans must show."""

from loomline.llm import sharding, substrings, suffixes


def final_plan(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("Initial Plan")[0]


def test_texts_are_shuffled_once(docs):
    for found in (substrings.word_repeats(docs), suffixes.byte_repeats(docs)):
        assert final_plan(found).count("ReusedExchange") == 1


def test_sharding_is_native(docs):
    plan = final_plan(sharding.kd_shards(docs))
    assert "Python" not in plan and "Arrow" not in plan
