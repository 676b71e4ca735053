"""Column functions of the reaction-network algebra."""
