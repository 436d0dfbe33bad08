"""Federated-ontology analytics as Spark jobs: snapshots, profiles, key and link
discovery, merged entities, published objects, metrics and operational feeds."""
