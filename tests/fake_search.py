def search(query, cursor, count):
    n = int(cursor or 0)
    return {"items": [{"identifier": f"{query}{n}", "title": f"t{n}", "mediatype": "software"}, {"identifier": "same", "title": f"t{n}"}], "cursor": str(n + 1) if n < 2 else None}


def record(identifier):
    body = {"gone": "[]", "bad": '{"error": "no rights"}', "odd": "5"}.get(identifier, '{"metadata": {"identifier": "%s"}}' % identifier)
    return 200, {}, body.encode()


def service(kind, body):
    import json

    if body.get("value") == "broken":
        return 500, {}, b""
    if kind == "upsert_file":
        return 200, {}, b'{"id": 1, "created": true}'
    if kind == "find_file_by_hash":
        return 200, {}, json.dumps({"found": body["value"] == "a", "file": {"id": 7}}).encode()
    return 200, {}, json.dumps(body, sort_keys=True).encode()
