"""Risk weights as tables. Ids and weights."""

from __future__ import annotations

KIND_BASE = {
    "agent": 15, "mcp-server": 15, "agent-config": 10, "workflow": 10, "bot-app": 10, "oauth-grant": 10, "service-identity": 10, "iam-grant": 10,
    "gateway-caller": 10, "cloud-resource": 5, "framework-usage": 5, "secret": 30, "token": 5, "infra": 10, "ai-app": 5, "local-model": 5,
    "network-contact": 5, "runtime-process": 10,
}
CAPABILITY = {
    "code-exec": 15, "autonomous": 10, "saas-actions": 10, "data-access": 10, "browsing": 5, "memory": 5, "multi-agent": 5, "delegated-identity": 5,
    "tool-use": 5, "mcp-server": 5, "rag": 3,
}
TAG = {
    "policy.privileged-scopes": 20, "policy.data-access-scopes": 10, "policy.llm-access-scopes": 5, "hardcoded-credential": 25, "plaintext-credential": 25,
    "inline-secrets": 15, "mcp-unpinned-package": 10, "mcp-insecure-transport": 0, "mcp-auto-approve": 0, "mcp-broad-filesystem": 10, "mcp-shell-command": 5,
    "posture-permissions-bypassed": 15, "posture-unrestricted-shell": 10, "posture-unsandboxed": 10, "posture-exposed-gateway": 15,
    "posture-unauthenticated-gateway": 15, "secret-in-env": 10, "unmasked-ci-variable": 10, "ci-credentials": 5, "no-authentication": 15, "no-auth-declared": 10,
    "a2a-plaintext-interface": 10, "a2a-card-signature-invalid": 10, "iam-auth-only": 0, "public-ingress": 10, "exposed-llm-server": 15, "unauthenticated-mcp": 15,
    "tool-poisoning": 15, "tool-name-shadowing": 10, "unsafe-serialization": 15, "privileged-pod": 15, "cluster-admin": 20, "no-egress-policy": 10,
    "gpu-workload": 3, "public-network": 5, "public-principal": 20, "api-key-auth-enabled": 5, "no-guardrail": 5, "no-content-moderation": 5,
    "no-invocation-logging": 5, "no-diagnostic-logging": 5, "tracing-disabled": 3, "wildcard-permissions": 15, "all-repositories": 5, "write-access": 5,
    "always-on": 5, "scheduled": 5, "event-triggered": 3, "long-lived-credentials": 5, "user-managed-keys": 10, "client-secret": 5, "unrestricted-api-key": 15,
    "anonymous-client": 5, "app-only-permissions": 5, "self-authorisable": 5, "user-owned-integration": 5, "not-directory-approved": 5,
    "no-end-user-attribution": 5, "delegation": 3, "agent-claims": 3, "identity:delegated-agent": 10, "identity:service": 5, "token-hygiene": 5,
    "meeting-bot": 10, "automation": 5, "agent-platform": 5, "assistant": 3, "coding": 5, "custom-app": 3, "bot-user": 3, "managed-secret": 0,
    "pending-request": 0, "disabled": -10, "inactive": -10, "suspended": -10, "expired": -5, "asks-user": -3, "test-code-only": -10, "docs-only": -8,
    "example-code-only": -8, "generated-code-only": -10, "hidden-instructions": 20, "remote-code-fetch": 15, "invisible-text": 10, "autonomy-understated": 10,
}
PROVIDER = {
    "provider.google-gemini": 5, "provider.openrouter": 10, "provider.deepseek": 10, "provider.openai-compatible": 5, "provider.together": 3,
    "provider.fireworks": 3, "provider.groq": 3, "provider.perplexity": 5, "provider.huggingface": 3, "provider.ollama": -3, "provider.vllm": -3,
}
GOVERNANCE = {"shadow": 25, "registered": -10, "no-owner": 10, "mcp-not-in-approved-registry": 15}
#: Tags whose loss widens a finding.
MITIGATING = ("disabled", "inactive", "suspended", "expired", "asks-user", "test-code-only", "docs-only", "example-code-only", "generated-code-only", "pending-request", "managed-secret", "mcp-registry-published")
