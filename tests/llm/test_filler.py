"""Filler words are exemplars: scored over windows, with harmless exemplars competing."""

from __future__ import annotations

import numpy as np
import pytest

from plaza.llm import residue

LOREM = residue.FILLER[0][1].split()


@pytest.fixture(scope="module")
def judge():
    index = residue.default_index()
    return residue.Judge(index, np.full(len(index.terms), 5.0))


@pytest.mark.parametrize(
    "text",
    [
        "Lorem ipsum",
        "our teapot: lorem ipsum new dolor sit amet, thanks",
        "we like blah blah blah so",
        "foo bar baz",
        " ".join(LOREM[:20]),
        "typesetters still joke about lorem ipsum on every poster. " + "we went home and had tea. " * 20 + " ".join(LOREM[:12]),
        "typesetters still joke about lorem ipsum on every poster: " + " ".join(LOREM[:19]),
    ],
)
def test_filler_is_found(judge, text):
    assert judge([text]).tolist() == [True]


@pytest.mark.parametrize(
    "text",
    [
        "typesetters still joke about lorem ipsum on every poster",
        "typesetters still joke about lorem ipsum dolor sit amet on every poster",
        "please sit and do magna things while we sit",
        "a test of testing takes time",
        "",
    ],
)
def test_harmless_talk_is_not(judge, text):
    assert judge([text]).tolist() == [False]


def test_windows_do_not_cross_documents(judge):
    assert judge(["we saw lorem dolor", "sit amet on the wall", None, "blah blah", "blah"]).tolist() == [False] * 5
