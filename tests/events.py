"""Inline events of an invented recordings archive, built from the event schema."""

import json

CMS = "http://archive.test"
REPO = "http://vault.test/store"
UUID = "5eed0000-1111-4222-8333-0000000000a7"
SHORT_UUID = "5eed0000-1111"
FILE_UUID = "5eed0000-1111-4222-8333-00000000f11e"
WORK_URL = f"{CMS}/works/tide-chart-17"
TAKE_URL = f"{CMS}/takes/0440"
SCAN_URL = f"{CMS}/scans/ledger-31.tif"
SOURCE_FIELD = "field_master_tape"


def link(href, media_type, rel, label):
    return {"type": "Link", "rel": rel, "mediaType": media_type, "href": href, "name": label}


def links(base, jsonld=True):
    """The links of an object: its page, an edit form, and machine-readable views."""
    out = [link(base + "/edit", "text/html", "edit-form", "Edit form"),
           link(base, "text/html", "canonical", "Page"),
           link(base + "?_format=json", "application/json", "alternate", "Record")]
    if jsonld:
        out.append(link(base + "?_format=jsonld", "application/ld+json", "alternate", "Graph"))
    return out


def event(kind, obj, target=None, content=None):
    """One event body; optional members are left out when None."""
    ev = {"type": kind, "summary": f"{kind} in the archive", "@context": "https://www.w3.org/ns/activitystreams",
          "object": obj,
          "actor": {"type": "Service", "id": "urn:uuid:5eed0000-1111-4222-8333-00000000b07b",
                    "url": [link(f"{CMS}/robots/ingest", "text/html", "canonical", "Ingest robot")]}}
    if content is not None:
        ev["attachment"] = {"mediaType": "application/json", "type": "Object", "content": content}
    if target is not None:
        ev["target"] = target
    return json.dumps(ev)


def _object(uuid, urls, version):
    obj = {"type": "Object", "url": urls, "id": f"urn:uuid:{uuid}"}
    return obj if version is None else {**obj, "isNewVersion": version}


def node_event(version=None, target=True, uuid=UUID):
    return event("Update", _object(uuid, links(WORK_URL), version), f"{REPO}/works" if target else None)


def media_event(version=None, source_field=SOURCE_FIELD):
    content = {} if source_field is None else {"source_field": source_field}
    return event("Update", _object("5eed0000-1111-4222-8333-000000000440", links(TAKE_URL), version),
                 f"{REPO}/takes", content)


def external_event():
    page = link(SCAN_URL, "image/tiff", "canonical", "Scan")
    return event("Create", _object(FILE_UUID, [page], None), f"{REPO}/scans", {})
