"""HTML rules on pages that the driver's tables do not have, the words of the content view, and token counts without a rank file on the executor."""

import numpy as np
import public_tokenizers as tokenizers
import pytest

from panelwright.llm import attribution, cotraining, html_text

PLAN = "The plan for the bridge was approved by the council on Monday and the work starts soon in the town."


@pytest.mark.parametrize("name", ["ad-hoc", "share-price", "cookie-recipe", "notice-of-motion", "widget-table"])
def test_a_name_with_other_words_is_no_outside_name(name):
    assert html_text.main_text(f'<article><p class="{name}">{PLAN}</p><div id="related-work"><p>{PLAN}</p></div></article>') == f"{PLAN}\n{PLAN}"


@pytest.mark.parametrize("name", ["comments", "comment-list", "share-buttons", "cookie-notice", "ad-slot-3", "related-posts", "newsletter-signup"])
def test_a_name_with_words_of_layout_is_one(name):
    assert html_text.main_text(f'<article><p>{PLAN}</p><div class="{name}"><p>{PLAN} {PLAN}</p></div><p>{PLAN}</p></article>') == f"{PLAN}\n{PLAN}"


def test_a_teaser_is_not_the_article():
    page = f'<div id="content"><p>{PLAN} {PLAN}</p><p>{PLAN}</p></div><article><p>Read this other story.</p></article>'
    assert html_text.main_text(page).startswith(f"{PLAN} {PLAN}\n{PLAN}")
    assert html_text.main_text(f"<article><p>{PLAN} {PLAN}</p></article><section><p>{PLAN}</p></section>") == f"{PLAN} {PLAN}"


def test_an_article_in_an_article_is_a_comment():
    page = f'<article><p>{PLAN} {PLAN} {PLAN}</p><section id="discussion"><article><p>{PLAN}</p></article></section></article>'
    assert html_text.main_text(page) == f"{PLAN} {PLAN} {PLAN}"
    assert html_text.main_text(f"<article><article><p>{PLAN}</p></article></article>") == PLAN


@pytest.mark.parametrize("tag", ["svg", "canvas", "object", "noscript", "template"])
def test_an_element_that_is_not_closed_hides_nothing(tag):
    assert html_text.main_text(f"<p>{PLAN}</p><{tag}><p>{PLAN}</p>") == f"{PLAN}\n{PLAN}"
    assert html_text.main_text(f"<p>{PLAN}</p><script>if (a) {{ <p>{PLAN}</p>") == PLAN


def test_one_quote_without_an_end_touches_its_tag_only():
    page = f"<p><a href=\"x>there</a> {PLAN}</p><p title='a > b'>{PLAN}</p>"
    assert html_text.main_text(page) == f"there {PLAN}\n{PLAN}"
    assert html_text.main_text('<i b="x>' * 20_001 + f"<p>{PLAN}</p>") == PLAN  # in linear time


def test_pages_of_other_languages_and_short_pages_have_text():
    other = "Hän kertoi eilen kaupungintalolla että uusi silta rakennetaan ensi vuonna joen yli vanhan sillan paikalle."
    assert html_text.main_text(f"<nav><a>Etusivu</a></nav><p>{other}</p>") == other
    assert html_text.main_text("<p>Short note.</p>") == "Short note."
    assert html_text.main_text("<nav><a>Home</a></nav><p>Login</p>") == ""


def test_the_content_view_sees_words():
    good, bad = (cotraining.content_features(t) for t in (PLAN, PLAN.replace("bridge", "casino").replace("council", "scammer")))
    assert np.abs(good - bad).max() > 0
    words = slice(cotraining.SHAPES + 6, None)
    assert (good[words] ** 2).sum() == pytest.approx(1, abs=1e-5) and not cotraining.content_features(None).any()
    assert (cotraining.content_features("Town town, TOWN!")[words] > 0).sum() == 1


def test_features_score_as_texts_do(spark, docs):
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 13)], "doc_id long, quality int, toxic int")
    every = cotraining.features(docs)
    model = cotraining.train_on(every, labels)
    by_text = {r["doc_id"]: r["score"] for r in cotraining.classify(docs, model).collect()}
    assert {r["doc_id"]: r["score"] for r in cotraining.score_features(every, model).collect()} == pytest.approx(by_text)


def test_token_counts_carry_the_rank_file(spark, docs, tmp_path):
    own = tmp_path / "ranks"
    own.write_bytes(open(tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    counted = attribution.by_section(docs.select("doc_id", "text"), str(own), tokenizers.PATTERN)
    own.unlink()
    assert {r["doc_id"]: r["tokens"]["n_tokens"] for r in counted.collect()}[9] == 2
