import random
import string
import time

from graphloom.llm.secrets import novel_spans

KEY = "q7Zt0PwXk3LmB9vRj2HsY5cNd8FgUa4E"
LONG_KEY = "".join(random.Random(6).choices(string.ascii_letters + string.digits, k=40))


def found(text):
    return [text[s:e] for s, _, e in novel_spans(text)]


def test_every_candidate_in_reach_is_measured():
    assert LONG_KEY in found(f'secret_access_key_production_us_east = "{LONG_KEY}"')
    assert found(f"token for default_configuration_manager {KEY} here") == [KEY]
    assert found(f"the token is {LONG_KEY} {KEY} now") == [LONG_KEY, KEY]


def test_a_candidate_within_a_longer_one():
    assert found(f"secret application_environment_configuration_private_key={KEY[:20]}") == ["_key=" + KEY[:20]]
    assert found(f"token of client_environment_configuration_manager_private_key={KEY[:20]} {LONG_KEY}") == ["_key=" + KEY[:20], LONG_KEY]


def test_long_runs_of_words_take_no_quadratic_time():
    before = time.monotonic()
    assert found("key" * 60_000) == []
    assert time.monotonic() - before < 60


def test_keys_without_digits_are_measured():
    letters = "qWzTkPbXhLrMvBnRjYsHcNdFgUaEoKi"
    assert found(f"auth header sends {letters} each time") == [letters]
    assert found("auth header sends the_default_configuration_manager each time") == []


def test_every_position_of_a_long_run_is_measured():
    rng = random.Random(9)
    secret = "".join(rng.choices(string.ascii_letters + string.digits, k=3000))
    filler = "the_default_configuration_manager_" * 60
    # Neither the whole run nor a half of it is dense enough; what follows the last word is.
    text = f"token {filler}auth_{filler[:700]}key_{secret}"
    assert found(text)[0].endswith(secret) and len(found(text)[0]) < 3800
    assert found(f"token {filler * 4}") == []
    long_hex = "".join(rng.choices("0123456789abcdef", k=5000))
    assert found(f"token {long_hex}") == [long_hex]
