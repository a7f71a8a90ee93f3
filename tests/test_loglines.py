import hashlib
from datetime import datetime

from pricelens.operators.loglines import LAYOUTS, entries, parse_logs, resolve, signature

LINES = {
    '{"ts": "2026-04-27T14:18:17.584Z", "level": "info", "logger": "captura", "msg": "a\\nb"}': ("2026-04-27 14:18:17", "INFO", "captura", "a\nb"),
    '{"message":"p\\u00e1gina","severity":"CRITICAL","component":"cba","time":"2026-06-10T20:59:46-03:00"}': ("2026-06-10 20:59:46", "CRITICAL", "cba", "página"),
    'ts=2026-05-21T20:00:12Z level=warn component=sesion msg="dijo \\"no\\" | p3"': ("2026-05-21 20:00:12", "WARNING", "sesion", 'dijo "no" | p3'),
    "2026-03-30 08:16:41,587 - csv-writer - INFO - enlaces 3": ("2026-03-30 08:16:41", "INFO", "csv-writer", "enlaces 3"),
    "2026-06-18 10:16:39,672 DEBUG [dom.scroll] sin cambios": ("2026-06-18 10:16:39", "DEBUG", "dom.scroll", "sin cambios"),
    "INFO  28-04-2026 14:50:55.889 (hilo-3) cl.precios.captura: inicio": ("2026-04-28 14:50:55", "INFO", "cl.precios.captura", "inicio"),
    "<11>Apr 17 13:02:23 nodo-3 csv-writer[1074]: fila": ("2025-04-17 13:02:23", "ERROR", "csv-writer", "fila"),
    "W0406 21:05:47.747000   4047 sesion:17] lista": ("2025-04-06 21:05:47", "WARNING", "sesion", "lista"),
    "[10/06/2026 21:00:07] FATAL cba - disco lleno?": ("2026-06-10 21:00:07", "CRITICAL", "cba", "disco lleno?"),
    "[04/05/2026 15:36:53] \x1b[33mINFO\x1b[0m  paginador - x": ("2026-05-04 15:36:53", "INFO", "paginador", "x"),
    "[WARNING] (cba) HTTP 503": ("", "WARNING", "cba", "HTTP 503"),
    "1777072697568|E|bff|sin cambios | filas 23": ("2026-04-24 23:18:17", "ERROR", "bff", "sin cambios | filas 23"),
}
CONTINUATIONS = ["Traceback (most recent call last):", " - [Verduras] fila 203", "    > 2026-04-15 10:16:00,120 INFO [copia] línea", '{"sku": "698", "precio": 1}', "[Pastas] (algo) más", "=== inicio ===", "", "{", "99|X|y|z", "2026-13-45 99:99:99 INFO [x] y"]


def test_each_layout():
    for line, (ts, level, component, message) in LINES.items():
        (x,) = entries(line, 2025, {})
        assert (*x.entry[:3], x.message) == (ts, level, component, message), line
    assert {n for line in LINES for n in resolve(signature(line))} == set(range(len(LAYOUTS)))


def test_continuations_belong_to_the_entry_above():
    for c in CONTINUATIONS:
        assert not list(entries(c, 2025, {})), c
    first, second = list(LINES)[-2:]
    log = "\r\n".join(["antes", first, *CONTINUATIONS[:4], "", "  ", second, "", ""])
    a, b = entries(log, 2025, {})
    assert (a.line_no, a.n_lines, b.line_no, b.n_lines) == (2, 5, 9, 1)
    assert a.message == "\n".join(["HTTP 503", *CONTINUATIONS[:4]])
    assert a.msg_md5 == hashlib.md5(a.message.encode()).hexdigest()


def test_operator_on_odd_rows(spark):
    schema = "run_id bigint, stdout_log string, stderr_log string, started_at timestamp_ntz, k string, year int"
    log = list(LINES)[6]
    rows = [(1, None, "", datetime(2025, 1, 1), "x", 1), (2, log, log, None, None, None), (2, log, None, datetime(2024, 12, 31), None, None), (3, "\n" * 2000 + log + "\n" + "y" * 200_000, None, datetime(2024, 1, 1), None, None)]
    got = parse_logs(spark.createDataFrame(rows, schema), {"stdout": "stdout_log", "stderr": "stderr_log"}).collect()
    assert sorted((r.run_id, r.flujo, r.line_no, r.n_lines, r.entry_ts) for r in got) == [(2, "stderr", 1, 1, ""), (2, "stdout", 1, 1, ""), (2, "stdout", 1, 1, "2024-04-17 13:02:23"), (3, "stdout", 2001, 2, "2024-04-17 13:02:23")]
    assert parse_logs(spark.createDataFrame([], schema), {"stdout": "stdout_log"}).count() == 0
