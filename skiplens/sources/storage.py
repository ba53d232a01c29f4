"""Table paths and storage options."""

from __future__ import annotations

import os
from urllib.parse import unquote, urlparse

#: Schemes of other tools and what Hadoop calls them.
HADOOP_SCHEMES = {"s3": "s3a", "az": "abfss", "azure": "abfss", "gcs": "gs"}


class TableError(ValueError):
    """A table that can't be read."""


#: Settings of the S3, Azure and Google connectors that options stand for.
S3 = {"region": "fs.s3a.endpoint.region", "aws_region": "fs.s3a.endpoint.region", "aws_endpoint": "fs.s3a.endpoint", "aws_access_key_id": "fs.s3a.access.key", "aws_secret_access_key": "fs.s3a.secret.key", "aws_session_token": "fs.s3a.session.token"}
AZURE = {"account_key": "fs.azure.account.key", "azure_storage_account_key": "fs.azure.account.key", "sas_token": "fs.azure.sas.fixed.token", "azure_storage_sas_token": "fs.azure.sas.fixed.token", "client_id": "fs.azure.account.oauth2.client.id", "azure_client_id": "fs.azure.account.oauth2.client.id", "client_secret": "fs.azure.account.oauth2.client.secret", "azure_client_secret": "fs.azure.account.oauth2.client.secret"}
GOOGLE = {"google_service_account": "fs.gs.auth.service.account.json.keyfile", "service_account": "fs.gs.auth.service.account.json.keyfile", "project_id": "fs.gs.project.id"}
#: By connector: what asking for unsigned requests, and for credentials of the environment, sets.
UNSIGNED = {"s3a": {"fs.s3a.aws.credentials.provider": "org.apache.hadoop.fs.s3a.AnonymousAWSCredentialsProvider"}, "gs": {"fs.gs.auth.type": "UNAUTHENTICATED"}}
FROM_ENV = {"s3a": {"fs.s3a.aws.credentials.provider": "software.amazon.awssdk.auth.credentials.EnvironmentVariableCredentialsProvider"}, "gs": {"fs.gs.auth.type": "APPLICATION_DEFAULT"}, "abfss": {"fs.azure.account.auth.type": "OAuth", "fs.azure.account.oauth.provider.type": "org.apache.hadoop.fs.azurebfs.oauth2.MsiTokenProvider"}}


def _account(options: dict[str, str]) -> str | None:
    return options.get("account_name") or options.get("azure_storage_account_name")


def table_path(path: str, options: dict[str, str] | None = None) -> str:
    """A path that Spark can read: remote URLs with Hadoop's scheme, local folders absolute.

    A container on Azure gets the host of the account that the options name.
    """
    url = urlparse(path)
    if url.scheme and url.scheme != "file" and (url.netloc or url.path.startswith("/")):
        scheme, rest = HADOOP_SCHEMES.get(url.scheme, url.scheme), path[len(url.scheme) :]
        if scheme == "abfss" and "@" not in url.netloc and (account := _account(options or {})):
            rest = rest.replace(url.netloc, f"{url.netloc}@{account}.dfs.core.windows.net", 1)
        return f"{scheme}{rest}".rstrip("/")
    local = unquote(url.path) if url.scheme == "file" else path
    if not os.path.isdir(local):
        raise TableError(f"Invalid path '{path}': no such directory")
    return os.path.realpath(local)


def storage_options(region: str | None = None, public: bool = False, env_creds: bool = False, options: list[str] | tuple[str, ...] = ()) -> dict[str, str]:
    """Options by lower-case key; of repeated keys the last counts, and any of them before a flag."""
    if bad := [x for x in options if "=" not in x]:
        raise TableError(f"'{bad[0]}' is no storage option of the form KEY=VALUE")
    flags = {"region": region, "skip_signature": public and "true", "allow_env": env_creds and "true"}
    return {k: v for k, v in flags.items() if v} | {k.lower(): v for k, _, v in (x.partition("=") for x in options)}


def hadoop_options(options: dict[str, str], path: str = "s3a://") -> dict[str, str]:
    """The settings of the path's connector that stand for these options; keys with a dot pass as they are."""
    scheme = HADOOP_SCHEMES.get(urlparse(path).scheme, urlparse(path).scheme)
    names = {"s3a": S3, "abfss": AZURE, "gs": GOOGLE}.get(scheme, {})
    out = {names.get(k, k): v for k, v in options.items() if k in names or "." in k}
    if scheme == "abfss" and (account := _account(options)) and "fs.azure.account.key" in out:
        out[f"fs.azure.account.key.{account}.dfs.core.windows.net"] = out.pop("fs.azure.account.key")
    for flag, settings in (("allow_env", FROM_ENV), ("skip_signature", UNSIGNED)):
        if options.get(flag) == "true":
            out |= settings.get(scheme, {})
    return out
