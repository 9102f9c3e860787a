"""Sources: commit logs, source trees, manifests, secrets in added lines."""
