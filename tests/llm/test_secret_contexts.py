"""Keys of wider credential contexts that are the end of a longer name, and short values."""

from __future__ import annotations

import pytest

from granary.llm import secrets


@pytest.mark.parametrize(
    ("text", "value"),
    [
        ("aws_secret_access_key = wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY", "wJalrXUtnFEMI/K7MDENG/bPxRfiCYEXAMPLEKEY"), ("DB_PASS=x9$Kq2!vLm7#Tz", "x9$Kq2!vLm7#Tz"), ("MYSQL_PWD: x9$Kq2!vLm7#Tz", "x9$Kq2!vLm7#Tz"),
        ("SSH_PRIVATE_KEY=x9$Kq2!vLm7#Tz", "x9$Kq2!vLm7#Tz"), ("x-auth: x9$Kq2!vLm7#Tz", "x9$Kq2!vLm7#Tz"), ("pwd=#K!$%^&", "#K!$%^&"),
    ],
)
def test_prefixed_keys_and_short_values(text, value):
    at = text.index(value)
    assert secrets.find_spans(text)[0] == [(at, at + len(value), "guess")]
    assert secrets.redact(text) == text[:at] + "[guess]"


@pytest.mark.parametrize("text", ["compass = x9$Kq2!vLm7#Tz", "my_bypass: x9$Kq2!vLm7#Tz", "DB_PASS=monkey12", "pwd=abc"])
def test_other_words_and_easy_values(text):
    assert secrets.find_spans(text)[0] == []
