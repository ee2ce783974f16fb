"""Secrets that are assigned to longer names."""

import re

import pytest
from test_pii import one

NAMES = ["DB_PASSWORD=", "client_secret: ", "aws_secret_access_key = ", "spring.datasource.password=", "x-api-key: ", "api key = ", "Access-Key: ", "S3_2_TOKEN=", "clientSecret = ", '{"db_password": "', "password=", "api_key="]


def test_longer_names_of_secrets(spark):
    value = "9fK2mQ7xLw0Z"
    texts = [name + value for name in NAMES]
    for name, got in zip(NAMES, one(spark, *texts), strict=True):
        assert got.startswith(name) and value not in got
        assert re.fullmatch(r"[A-Za-z0-9]{12}", got[len(name) :])


def test_what_stands_before_a_name_is_still_replaced(spark):
    texts = ["10.20.30.40.token=9fK2mQ7xLw0Z", "host-10.20.30.40.token=9fK2mQ7xLw0Z", "my.token@mail.com"]
    for got in one(spark, *texts):
        assert not re.search(r"10\.20\.30\.40|9fK2mQ7xLw0Z|my\.token@mail", got)


def test_long_tokens_and_words_stay(spark):
    clean = ["secretary: appointed yesterday", "tokenizer=something", "_" * 5000, "a-" * 5000, "a." * 5000 + "b", "Ab" * 5000, "the tokens were lost"]
    assert one(spark, *clean) == clean
