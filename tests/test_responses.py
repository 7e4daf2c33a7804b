import json

from pyspark.sql import functions as F

from tagloom import apply_responses, build_prompts, build_requests, extract_pages, generate_metadata, generate_texts, response_texts
from tagloom.operators import responses as M

HTML = "<body><h1>Heading</h1><p>" + "Some words of a page. " * 10 + "</p></body>"


def pages(spark, n):
    rows = [(f"https://a.com/{i}", HTML) for i in range(n)]
    return extract_pages(spark.createDataFrame(rows, "url string, html string"))


def test_request_and_response_shapes(spark):
    prompts = spark.createDataFrame(
        [("anthropic", "", 'a "q"\n'), ("openai", "my-model", "p"), ("google", None, "p"), ("ownai", "", "p"), ("?", "", "p")],
        "provider string, model string, prompt string",
    )
    got = {r.provider: r.request_json and json.loads(r.request_json) for r in build_requests(prompts).collect()}
    assert got["anthropic"] == {
        "model": "claude-sonnet-4-5", "max_tokens": 1024, "messages": [{"role": "user", "content": 'a "q"\n'}],
    }
    assert got["openai"] == {"model": "my-model", "messages": [{"role": "user", "content": "p"}]}
    assert got["google"] == {
        "contents": [{"parts": [{"text": "p"}]}],
        "generationConfig": {"responseMimeType": "application/json"},
    }
    assert got["ownai"]["model"] == "default"
    assert got["?"] is None

    cases = [
        ("anthropic", 200, '{"content":[{"text":"hi"}]}', "hi", None),
        ("grok", 200, '{"choices":[{"message":{"content":"x\\ny"}}]}', "x\ny", None),
        ("grok", 200, "{}", "", None),
        ("openai", 200, "<html>", None, "response is not JSON"),
        ("google", 200, '{"candidates":[]}', None, 'empty answer: {"candidates":[]}'),
        ("openai", 429, "z" * 400, None, "API error 429: " + "z" * 300),
    ]
    df = spark.createDataFrame(
        [(str(i), p, s, raw) for i, (p, s, raw, _, _) in enumerate(cases)],
        "url string, provider string, http_status int, raw string",
    )
    got = {int(r.url): (r.text, r.error) for r in response_texts(df).collect()}
    assert got == {i: (c[3], c[4]) for i, c in enumerate(cases)}


def test_salvage(spark):
    cases = [
        ('Here: {"a":1} done', '{"a":1}'), ("{ }", None), ("{}", None), ("none", None), ("{bad}", None),
        ('{"a":1} and {"b":2}', None), ('x {"a":{"b":2}}\n', '{"a":{"b":2}}'), (None, None),
    ]
    df = spark.createDataFrame(cases, "t string, want string")
    for r in df.withColumn("got", M.salvage_json("t")).collect():
        assert r.got == r.want


def test_apply(spark):
    answer = {"title": "T" * 70, "description": "Some text. " * 20, "suggestions": ["a", "b"]}
    texts = spark.createDataFrame(
        [
            ("https://a.com/0", "openai", "```json\n" + json.dumps(answer) + "\n```", None),
            ("https://a.com/1", "openai", "no json", None),
            ("https://a.com/2", "openai", None, "API error 500: x"),
            ("https://a.com/4", "openai", '{"title":null,"description":3,"llms_txt":"own"}', None),
            ("https://a.com/4", "openai", '{"title":null,"description":3,"llms_txt":"own"}', None),
        ],
        "url string, provider string, text string, error string",
    )
    got = {r.url[-1]: r for r in apply_responses(pages(spark, 5), texts).collect()}
    assert len(got) == 5
    assert got["0"].ai_powered and got["0"].title == "T" * 59 + "…" and len(got["0"].description) <= 160
    assert got["0"].ai_suggestions == ["a", "b"] and got["0"].keywords == ""
    assert got["0"].provider == "GPT-4o (OpenAI)" and got["0"].llms_txt.startswith("# TTT")
    assert not got["1"].ai_powered and got["1"].ai_error and got["1"].title == "Heading – A"
    assert got["2"].error == "API error 500: x" and got["2"].ai_error is None
    assert got["3"].error == "no model response"
    assert (got["4"].title, got["4"].description, got["4"].llms_txt) == ("", "3", "own")


def test_prompt_and_generator(spark, tmp_path):
    overrides = spark.createDataFrame([("https://a.com/0", None, "kw", None)], "url string, title string, keywords string, description string")
    prompts = build_prompts(pages(spark, 3), overrides).withColumn("provider", F.lit("ownai"))
    texts = {r.url[-1]: r.prompt for r in prompts.collect()}
    assert "Keywords set by the user: kw" in texts["0"] and "Keywords" not in texts["1"].split("Text:")[0]
    assert "URL: https://a.com/1\n" in texts["1"] and "Main heading: Heading" in texts["1"]

    log = str(tmp_path / "calls")

    def generate(prompt):
        url = prompt.split("URL: ")[1].split("\n")[0]
        with open(log, "a") as f:
            f.write(url + "\n")
        calls = open(log).read().count(url)
        if url.endswith("1") and calls < 3:
            raise RuntimeError("API error 503: busy")
        if url.endswith("2"):
            raise RuntimeError("API error 400: no")
        return '{"title":"x"}'

    out = {r.url[-1]: (r.text, r.error) for r in generate_texts(prompts, generate).collect()}
    assert out == {"0": ('{"title":"x"}', None), "1": ('{"title":"x"}', None), "2": (None, "API error 400: no")}
    assert len(open(log).read().split()) == 1 + 3 + 1
    attempts = M.generate_attempts(prompts, generate).collect()
    assert [(r.n, r.ok, r.final) for r in attempts if r.url.endswith("2")] == [(1, False, True)]
    assert sum(r.final for r in attempts) == 3
    assert [(r.n, r.error) for r in M.generate_attempts(prompts, generate, max_attempts=0).collect()] == [(0, "no attempt made")] * 3
    by_rule = generate_metadata(pages(spark, 1), "none").collect()[0]
    assert (by_rule.provider, by_rule.ai_powered) == ("Regelbasiert", False)
    answers = generate_texts(prompts, generate)
    assert {r.ai_powered for r in generate_metadata(pages(spark, 1), "ownai", answers).collect()} == {True}
    assert M.rules_or_model("none") == M.rules_or_model("?") == "rules" and M.rules_or_model("grok") == "model"
