"""Driver-side configuration (small, bounded by the number of config keys)."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

# --- fixed values: property keys understood by the engine -----------------
KEY_MAX_REDELIVERIES = "error.maxRedeliveries"
KEY_HTTP_OPTIONS = "http.additional_options"
KEY_INDEXER_ENABLED = "indexer.enabled"
KEY_NODE_STREAM = "indexer.node"
KEY_DELETE_STREAM = "indexer.delete"
KEY_MEDIA_STREAM = "indexer.media"
KEY_EXTERNAL_STREAM = "indexer.external"
KEY_SERVICE_BASE = "indexer.service.baseUrl"
KEY_TRIPLES_ENABLED = "triplestore.indexer.enabled"
KEY_TRIPLES_INDEX_STREAM = "triplestore.index.stream"
KEY_TRIPLES_DELETE_STREAM = "triplestore.delete.stream"
KEY_TRIPLES_BASE = "triplestore.baseUrl"
KEY_DERIVATIVES = "derivative.systems.installed"
# Keys of our own (not part of the original property set).
KEY_BASE_HEADER = "sync.base_url_header"
KEY_AUTH_TOKEN = "sync.auth_token"
KEY_RECIPIENTS_HEADER = "sync.recipients_header"
KEY_MESSAGE_ID_HEADER = "sync.message_id_header"

KNOWN_KEYS = [v for k, v in list(globals().items()) if k.startswith("KEY_")]

DEFAULT_MAX_REDELIVERIES = 5

# --- fixed values: how a property string reads as a boolean ----------------
TRUE_WORDS = ("true", "on", "yes", "1")


def read_bool(value: str | None, default: bool) -> bool:
    """Absent -> default; true/on/yes/1 (trimmed, any case) -> True; anything
    else, including an empty value, -> False (the switch is not on)."""
    if value is None:
        return default
    return value.strip().lower() in TRUE_WORDS


@dataclass(frozen=True)
class Settings:
    """Resolved configuration used to build plans.

    Values are constants of a deployment, so they are folded into the plan as
    literals (the HTTP option suffix is built once here, not per row).
    """

    service_base_url: str = "http://localhost:8000/sync/"
    node_stream: str = "queue:node"
    delete_stream: str = "queue:delete"
    media_stream: str = "queue:media"
    external_stream: str = "queue:external"
    triples_index_stream: str = "queue:node"
    triples_delete_stream: str = "queue:delete"
    triples_base_url: str = "http://localhost:8080/sparql"
    indexer_enabled: bool = True
    triples_enabled: bool = True
    max_redeliveries: int = DEFAULT_MAX_REDELIVERIES
    http_options: str = ""
    base_url_header: str = "X-Repository-Base-Url"
    auth_token: str | None = None
    recipients_header: str = "X-Recipients"
    message_id_header: str = "message-id"
    extra: dict = field(default_factory=dict)

    def with_(self, **kw) -> "Settings":
        return replace(self, **kw)

    @property
    def attempt_limit(self) -> int | None:
        """1 first delivery + N redeliveries; None when N is negative
        (redeliver for ever: a request never fails, it stays pending until a
        terminal answer)."""
        if self.max_redeliveries < 0:
            return None
        return self.max_redeliveries + 1

    @classmethod
    def from_map(cls, props: dict[str, str], aliases: dict[str, str] | None = None) -> "Settings":
        """Build from resolved properties.

        ``aliases`` maps a deployment's own key names to the keys above
        (``{"my.node.queue": "indexer.node"}``), so an existing properties
        file can be used unchanged.
        """
        if aliases:
            props = {**props, **{ours: props[theirs] for theirs, ours in aliases.items() if theirs in props}}
        def get_bool(key: str, default: bool) -> bool:
            return read_bool(props.get(key), default)

        base = cls()
        node = props.get(KEY_NODE_STREAM, base.node_stream)
        delete = props.get(KEY_DELETE_STREAM, base.delete_stream)
        return cls(
            service_base_url=props.get(KEY_SERVICE_BASE, base.service_base_url),
            node_stream=node,
            delete_stream=delete,
            media_stream=props.get(KEY_MEDIA_STREAM, base.media_stream),
            external_stream=props.get(KEY_EXTERNAL_STREAM, base.external_stream),
            triples_index_stream=props.get(KEY_TRIPLES_INDEX_STREAM, node),
            triples_delete_stream=props.get(KEY_TRIPLES_DELETE_STREAM, delete),
            triples_base_url=props.get(KEY_TRIPLES_BASE, base.triples_base_url),
            indexer_enabled=get_bool(KEY_INDEXER_ENABLED, True),
            triples_enabled=get_bool(KEY_TRIPLES_ENABLED, True),
            max_redeliveries=int(props.get(KEY_MAX_REDELIVERIES, DEFAULT_MAX_REDELIVERIES)),
            http_options=props.get(KEY_HTTP_OPTIONS, ""),
            base_url_header=props.get(KEY_BASE_HEADER, base.base_url_header),
            auth_token=props.get(KEY_AUTH_TOKEN),
            recipients_header=props.get(KEY_RECIPIENTS_HEADER, base.recipients_header),
            message_id_header=props.get(KEY_MESSAGE_ID_HEADER, base.message_id_header),
            extra=dict(props),
        )
