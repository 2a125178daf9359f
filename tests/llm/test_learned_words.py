"""Ranks of words learned from the corpus, and values that name a secret."""

from collections import Counter

import pytest

from misheard.llm import guess_cost

WORDS = "documentation international congratulations unfortunately".split()
SECRET = "qzkvjwpxrthgd"


def corpus():
    rows = [(k, f"{before} {w.title() if k % 2 else w}, and more.") for k, before in enumerate("the a some every of in".split())
            for w in WORDS]
    return rows + [(100 + k, f"the password: {SECRET} is set") for k in range(50)] + [(None, None), (7, "")]


def test_words_of_a_corpus(docs_of):
    docs = docs_of(corpus())
    words = guess_cost.learn_words(docs)
    assert set(WORDS) <= set(words) and SECRET not in words
    counts = Counter(guess_cost._word(t) for _, text in corpus() for t in (text or "").split())
    assert list(words) == sorted(words, key=lambda w: (-counts[w], w))
    assert words == guess_cost.learn_words(docs.repartition(5))
    assert guess_cost.learn_words(docs.limit(0)) == ()
    few = guess_cost.learn_words(docs, most=3)
    assert len(few) <= 3 and few == words[: len(few)]


@pytest.mark.parametrize("text", ["PIN: documentation", "token: international", "secret = congratulations", "password: unfortunately."])
def test_words_are_no_secrets(text):
    ranks = guess_cost.Ranks(tuple(WORDS))
    assert not any(f[0] == 3 for f in guess_cost.scan(text, ranks))
    assert guess_cost.without_secrets(text, "[SECRET]", ranks) == text


@pytest.mark.parametrize(
    "text",
    ["api_key: https://example.org/docs/keys", "password = os.environ['DB_PASSWORD_OF_THE_APP']", "token: ${DEPLOYMENT_TOKEN_VALUE}",
     "secret: settings.APPLICATION_SIGNING", "password = get_password_from_vault()", "private_key: /etc/ssl/private/server.pem",
     "token = read_token_of_user(name)", "api_key: {{credentials.production}}"],
)
def test_what_names_a_secret_is_none(text):
    assert not any(f[0] == 3 for f in guess_cost.scan(text))
    assert guess_cost.without_secrets(text, "[SECRET]") == text


@pytest.mark.parametrize(
    ("text", "secret"),
    [("password=letmein123", "letmein123"), ("password: sunshine", "sunshine"), (f"password: {SECRET}", SECRET),
     ("db_password: postgres://app:hV8qLz2mXc9@db/x", "postgres://app:hV8qLz2mXc9@db/x"),
     ("secret = /K7MDENGbPxRfiCYwJalrXUtnFEMI", "/K7MDENGbPxRfiCYwJalrXUtnFEMI"),
     ("token: international9Qx7VbL2mPz", "international9Qx7VbL2mPz")],
)
def test_secrets_are_still_found(text, secret):
    assert secret not in guess_cost.without_secrets(text, "[SECRET]", guess_cost.Ranks(tuple(WORDS)))


def test_base_spans_do_not_depend_on_words(docs_of):
    docs = docs_of(corpus())
    with_words = guess_cost.digests(docs, words=guess_cost.learn_words(docs)).collect()
    for a, b in zip(with_words, guess_cost.digests(docs).collect()):
        assert (a.n_assign, a.n_access, a.n_hex, a.base_sha256) == (b.n_assign, b.n_access, b.n_hex, b.base_sha256)
