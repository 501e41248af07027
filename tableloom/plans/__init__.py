"""End-to-end jobs: configured join, federated SQL, model training."""
