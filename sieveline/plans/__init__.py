"""Registered queries by name: (function of session and folder, DuckDB SQL or None)."""

from .bank_queries import QUERIES as _banks
from .evaluation_queries import QUERIES as _evaluation
from .event_queries import QUERIES as _events
from .message_queries import QUERIES as _messages
from .model_queries import QUERIES as _models
from .question_queries import QUERIES as _questions
from .record_queries import QUERIES as _records

QUERIES = {**_messages, **_events, **_models, **_banks, **_evaluation, **_records, **_questions}
