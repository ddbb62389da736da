"""Whole values in credential context: what the further kind adds to the base spans."""

import random

from rivulet.llm import secretscan
from rivulet.llm.spans import redact


def credentials(text):
    return [text[a:b] for kind, a, b in secretscan.find(text)[1] if kind == "credential"]


def clean(text):
    return redact(text, [(a, b) for _, a, b in secretscan.find(text)[1]], "[SECRET]")


def test_base_keywords_take_whole_values():
    for word in ("password", "PASSWD", "secret", "token", "api_key", "apikey"):
        assert credentials(f"{word}: P@ss#w0rd!92xQ") == ["P@ss#w0rd!92xQ"]
        assert credentials(f'{word}="k#9fQ2!xLw7$"') == ["k#9fQ2!xLw7$"]
    assert clean("my password: P@ss#w0rd!92xQ, ok") == "my password: [SECRET], ok"
    assert not credentials("password: changeme") and not credentials("the secret of the garden") and not credentials("password: [SECRET]")


def test_long_values_are_taken_whole():
    rng = random.Random(4)
    make = lambda n: "".join(rng.choice("abcdefghijkmnpqrstuvwxyzABCDEFGHJKLMNPQRSTUVWXYZ23456789") for _ in range(n))
    long = make(423)
    assert clean(f"head: Bearer {long} end") == "head: Bearer [SECRET] end"
    assert credentials(f"https://{make(90)}:{long}@host/x") == [long]
    assert credentials(f"pwd: {long * 30}") == [long * 30]
    for n in (400, 5000):
        value = make(n)
        for text in (f"Authorization: Bearer {value} x", f'client_secret="{value}#!" x', f"passphrase: {value.lower()} x", f"db://{make(80)}:{value}@h x"):
            left = clean(text)
            assert "[SECRET]" in left and not any(value[k : k + 20] in left or value.lower()[k : k + 20] in left for k in range(0, n - 20)), left[:200]
    assert credentials("passphrase: qxzvwkjhbnmrtplk") == ["qxzvwkjhbnmrtplk"]


def test_longer_credentials_stay_beside_base_spans():
    text = 'client_secret="Passw0rd99!@#zzQ8xY"'
    assert secretscan.find(text)[1] == [("assign", 7, 25), ("credential", 15, 34)]
    assert clean(text) == 'client_[SECRET]"'
    assert [k for k, _, _ in secretscan.find("token=abcdefQ123")[1]] == ["assign"]
    assert clean('x *** token = "ab8ca1b325bc4f85aa6a"### y') == 'x *** [SECRET]"### y'


def test_guess_cost_decides_on_all_values():
    assert credentials("passphrase: xkqzvjwphfmbtrlg") == ["xkqzvjwphfmbtrlg"]
    assert credentials("postgres://app:xkqzvjwphfmbtrlg@db/x") == ["xkqzvjwphfmbtrlg"]
    for text in ("bearer 8fk3Lq92mZx7Qw", "note: bearer 8fk3Lq92mZx7Qw", "auth: bearer 8fk3Lq92mZx7Qw", "auth=Bearer 8fk3Lq92mZx7Qw"):
        assert credentials(text) == ["8fk3Lq92mZx7Qw"]
    assert credentials('{"pwd":"g7#Kq2!mZ","pass":"b8$Lw3?nY"}') == ["g7#Kq2!mZ", "b8$Lw3?nY"]
    assert not credentials("pwd: dragonmonkey") and not credentials("please pass international borders") and not credentials("auth: bearer")
