"""The stateless text operators over streams."""
