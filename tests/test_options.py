from quire.functions.options import sanitize_options, with_defaults
from tests.conftest import one_col

CASES = [
    ('{"device":"auto"}', {}, None),
    ('{"x":1}', {}, None),
    ('{"end_page":""}', {}, None),
    ('{"end_page":null}', {}, None),
    ('{"formula":"false"}', {"formula": True}, None),
    ('{"formula":"0"}', {"formula": True}, None),
    ('{"formula":false}', {"formula": False}, None),
    ('{"formula":0}', {"formula": False}, None),
    ('{"end_page":"7"}', {"end_page": 7}, None),
    ('{"end_page":" 7 "}', {"end_page": 7}, None),
    ('{"end_page":3.7}', {"end_page": 3}, None),
    ('{"end_page":-3.7}', {"end_page": -3}, None),
    ('{"start_page":true}', {"start_page": 1}, None),
    ('{"start_page":-1}', {"start_page": -1}, None),
    ('{"end_page":"1_000"}', {"end_page": 1000}, None),
    ('{"end_page":"3.7"}', None, "invalid literal for int() with base 10: '3.7'"),
    ('{"method":"fast"}', None, "Invalid value for 'method': 'fast'"),
    ('{"device":"AUTO"}', None, "Invalid value for 'device': 'AUTO'"),
    ('{"lang":', None, "malformed options JSON"),
    ('{"lang":5}', {"lang": "5"}, None),
    ('{"lang":true}', {"lang": "True"}, None),
    ('[]', None, "options must be a JSON object"),
    ('{"end_page":[]}', None, "int() argument must be a string, a bytes-like object or a real number, not 'list'"),
    ('{"backend":"vlm-transformers","method":"ocr","device":"cuda","table":[1]}',
     {"backend": "vlm-transformers", "method": "ocr", "device": "cuda", "table": True}, None),
    (None, {}, None),
]


def test_options_golden(spark):
    df = one_col(spark, [c for c, _, _ in CASES], "raw")
    rows = df.select("raw", sanitize_options("raw").alias("r")).collect()
    got = {r.raw: r.r for r in rows}
    for raw, want, err in CASES:
        r = got[raw]
        assert r.error == err, (raw, r.error, err)
        if want is None:
            assert r.options is None
        else:
            present = {k: v for k, v in r.options.asDict().items() if v is not None}
            assert present == want, (raw, present, want)


def test_defaults(spark):
    df = one_col(spark, ['{"method":"txt","end_page":4}'], "raw")
    o = df.select(with_defaults(sanitize_options("raw").options).alias("o")).first().o
    assert o.asDict() == {"lang": "en", "backend": "pipeline", "method": "txt", "formula": True, "table": True,
                          "start_page": 0, "end_page": 4, "device": None}


def test_dataframe_form_matches_column_form(spark):
    from quire.functions.options import with_sanitized_options

    df = one_col(spark, [c for c, _, _ in CASES], "raw")
    a = {r.raw: r.r for r in df.select("raw", sanitize_options("raw").alias("r")).collect()}
    b = {r.raw: r.r for r in with_sanitized_options(df, "raw", "r").collect()}
    assert a == b
