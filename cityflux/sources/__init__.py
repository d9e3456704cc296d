"""Tables, payloads, messages and exports."""
