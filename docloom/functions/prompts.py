"""Request and response bodies of the comment models, as JSON columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Prompt wordings and request parameters.
CHAT_PROMPT = (
    "Generate a detailed comment in English for the following Go function. The comment should be "
    "written in a way that is helpful for other developers. Include the purpose of the function, a "
    "description of its parameters and return values, potential error conditions, and any side effects "
    "or important details. Here is the function :\n"
)
COMPLETION_PROMPT = "Generate a detailed comment in English for the following Go function:\n"
CHAT_SYSTEM = "You are a helpful assistant."
CHAT_MODEL = "gpt-3.5-turbo"
COMPLETION_MODEL = "claude-v1"
MAX_TOKENS = 150
TEMPERATURE = 0.7


def local_request(text: Column, version: Column) -> Column:
    return F.to_json(F.struct(text.alias("text"), version.alias("version")))


def chat_request(code: Column) -> Column:
    def message(role: str, content: Column) -> Column:
        return F.struct(F.lit(role).alias("role"), content.alias("content"))

    return F.to_json(
        F.struct(
            F.lit(MAX_TOKENS).alias("max_tokens"),
            F.array(
                message("system", F.lit(CHAT_SYSTEM)),
                message("user", F.concat(F.lit(CHAT_PROMPT), code)),
            ).alias("messages"),
            F.lit(CHAT_MODEL).alias("model"),
            F.lit(TEMPERATURE).alias("temperature"),
        )
    )


def completion_request(code: Column) -> Column:
    return F.to_json(
        F.struct(
            F.concat(F.lit(COMPLETION_PROMPT), code).alias("prompt"),
            F.lit(MAX_TOKENS).alias("max_tokens"),
            F.lit(COMPLETION_MODEL).alias("model"),
            F.lit(TEMPERATURE).alias("temperature"),
        )
    )


def request_body(provider: Column, code: Column, version: Column) -> Column:
    """Body for the row's provider, null for the template provider."""
    return (
        F.when(provider == "localai", local_request(code, version))
        .when(provider == "openai", chat_request(code))
        .when(provider == "anthropic", completion_request(code))
    )


_RESPONSE = (
    "comment string, completion string, "
    "choices array<struct<text: string, message: struct<content: string>>>"
)


def decode_response(provider: Column, body: Column) -> Column:
    """``struct<comment, error>`` of a response body; exactly one of the two is set."""
    reply = F.from_json(body, _RESPONSE)
    choice = F.get(reply["choices"], F.lit(0))
    chat = F.coalesce(choice["text"], choice["message"]["content"])
    comment = (
        F.when(provider == "openai", chat)
        .when(provider == "anthropic", F.coalesce(reply["completion"], F.lit("")))
        .when(provider == "localai", F.coalesce(reply["comment"], F.lit("")))
    )
    broken = F.try_parse_json(body).isNull() | ~F.ltrim(body).startswith("{")
    error = (
        F.when(body.isNull() | broken, F.lit("error decoding response"))
        .when((provider == "openai") & (F.coalesce(F.size(reply["choices"]), F.lit(0)) <= 0),
              F.lit("error: no choices found in response"))
        .when((provider == "openai") & chat.isNull(), F.lit("error: no text found in response choice"))
    )
    return F.struct(F.when(error.isNull(), comment).alias("comment"), error.alias("error"))
